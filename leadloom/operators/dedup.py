"""Duplicate accounts: blocking keys, candidates, master links and human decisions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text as t
from leadloom.functions.web import host_of
from leadloom.session import first_code, cut_lineage, lookup

# Any two accounts of a block are candidates. Candidates are written as links: each account of a block is linked to the
# first other one it has no settled decision with. `is_candidate` answers for any single pair.
HOLD_CONFIDENCE = 0.95


def fingerprints(leads: DataFrame, effective: DataFrame) -> DataFrame:
    """Blocking keys of each lead with the confidence and reason a shared key gives."""
    reference = F.concat(F.lit("source:"), F.col("source"), F.lit(":"), F.col("source_reference"))
    registration = F.concat(F.lit("registration:"), F.lower("organization.registration_id"))
    domain = F.concat(F.lit("domain:"), host_of(F.coalesce("organization.domain", "organization.website")))
    name = t.name_key(F.col("organization.name"))
    country = t.name_key(F.col("organization.country"))
    company = F.concat(F.lit("name-country:"), name, F.lit(":"), country)

    def entry(key: Column, confidence: float, reason: str) -> Column:
        return F.struct(key.alias("key"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    keys = F.filter(
        F.array(entry(reference, 1.0, "same-source-reference"), entry(registration, 1.0, "same-registration"),
                entry(domain, 0.95, "same-domain"), entry(company, 0.7, "same-name-and-country")),
        lambda e: e["key"].isNotNull(),
    )
    from_fields = leads.select("lead_id", F.inline(keys))
    mails = effective.where(F.col("kind").isin("business-email", "work-email") & (F.col("status") == "verified"))
    mail = t.text(F.lower("value"))
    from_mail = mails.where(mail.isNotNull()).select(
        "lead_id", F.concat(F.lit("email:"), mail).alias("key"), F.lit(0.95).alias("confidence"),
        F.lit("same-verified-email").alias("reason"))
    return from_fields.unionByName(from_mail)


def master_links(leads: DataFrame) -> DataFrame:
    """(lead_id, master_id) for every lead that is marked as a duplicate of an existing lead.

    Masters are found by pointer doubling: each round every open link jumps to its target's target, so a
    chain of n links needs log2(n) rounds. Links that run into a cycle stop at the node where they enter it.
    """
    ids = leads.select("lead_id")
    marked = leads.where(F.col("compliance.duplicate_of").isNotNull()).select(
        "lead_id", F.col("compliance.duplicate_of").alias("parent"))
    edges = lookup(marked, ids.select(F.col("lead_id").alias("parent")), "parent")
    edges = cut_lineage(edges, "edges")

    resolved, open_links = _resolve(edges.select("lead_id", F.col("parent").alias("master_id")))
    if open_links is None:
        return resolved
    # What is left lies on a cycle or leads into one, and by now every link ends on its cycle.
    members = open_links.select(F.col("master_id").alias("lead_id")).distinct()
    members = cut_lineage(members, "cycle")
    on_cycle = members.select("lead_id", F.col("lead_id").alias("master_id"))
    tails = edges.join(open_links.select("lead_id"), "lead_id", "left_semi").join(members, "lead_id", "left_anti")
    entered, _ = _resolve(tails.select("lead_id", F.col("parent").alias("master_id")))
    return resolved.unionByName(on_cycle).unionByName(entered)


def _resolve(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Follow links to nodes that have none; also return the links that never end, if any.

    Nodes at every smaller depth exist, so a round that finishes none leaves only links that never end. Their
    ends shrink to the nodes on cycles; once a doubling leaves the number of ends unchanged, the jumps permute
    the ends, so all of them lie on cycles.
    """
    state = cut_lineage(links.withColumn("done", F.lit(False)), "links")
    remaining, ends = state.count(), -1
    while remaining:
        ahead = state.select(
            F.col("lead_id").alias("master_id"), F.col("master_id").alias("_next"), F.col("done").alias("_done"))
        open_links = state.where(~F.col("done"))
        moved = lookup(open_links, ahead, "master_id", "left").select(
            "lead_id", F.coalesce("_next", "master_id").alias("master_id"),
            (F.col("_next").isNull() | F.col("_done")).alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved), "links")
        still, now_ends = state.where(~F.col("done")).agg(F.count(F.lit(1)), F.countDistinct("master_id")).first()
        if still and still == remaining and now_ends == ends:
            return state.where("done").drop("done"), state.where(~F.col("done")).drop("done")
        ends = now_ends if still == remaining else -1
        remaining = still
    return state.drop("done"), None


def block_members(keys: DataFrame, masters: DataFrame) -> DataFrame:
    """Distinct accounts (leads mapped to their masters) per blocking key."""
    mapped = keys.join(masters, "lead_id", "left").select(
        "key", F.coalesce("master_id", "lead_id").alias("account_id"), "confidence", "reason")
    return mapped.dropDuplicates(["key", "account_id"])


def block_ranks(members: DataFrame) -> DataFrame:
    """key, account_id and rank (from 1, by account) within the key; written once.

    The rows are sorted in ranges, so a block may spread over many tasks; a row's rank is its place in its range and
    the number of the block's rows in the ranges before.
    """
    ordered = members.repartitionByRange("key", "account_id").sortWithinPartitions("key", "account_id")
    placed = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()), "ranks").withColumn("range", F.shiftright("at", 33))
    parts = placed.groupBy("key", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "range", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return placed.join(parts, ["key", "range"]).select("key", "account_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("rank"))


# Numbers are looked at in runs of this length.
RUN = 1024


def first_free(taken: DataFrame, keys: list[str], number: str) -> DataFrame:
    """For each of `keys` the smallest positive whole number that is not among its numbers.

    In sorted order a number leaves its place where one is missing before it. That is looked for inside runs, and then among the
    runs, so no list is longer than a run or the number of runs.
    """
    run = F.expr(f"({number} - 1) div {RUN}")
    inside = taken.groupBy(*keys, run.alias("_run")).agg(F.array_sort(F.collect_set(number)).alias("_numbers"))
    start = F.col("_run") * RUN + 1
    ahead = F.filter(F.transform("_numbers", lambda n, i: F.when(n > start + i, start + i)), lambda n: n.isNotNull())
    gap = F.coalesce(F.get(ahead, F.lit(0)), F.when(F.size("_numbers") < RUN, start + F.size("_numbers")))
    runs = inside.select(*keys, "_run", gap.alias("_gap")).groupBy(*keys).agg(F.min("_gap").alias("_gap"), F.array_sort(F.collect_list("_run")).alias("_runs"))
    skipped = F.filter(F.transform("_runs", lambda r, i: F.when(r > i, F.lit(RUN) * i + 1)), lambda n: n.isNotNull())
    least = F.least("_gap", F.coalesce(F.get(skipped, F.lit(0)), F.size("_runs") * RUN + 1))
    return runs.select(*keys, least.cast("bigint").alias(number))


def candidate_links(members: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id), distinct: each account with the first other account of each of its blocks, settled pairs left out.

    The first two accounts of a block come from an aggregate; a member whose link is settled takes the first account of its
    block whose rank is not that of a settled one. Ranks and gaps are found by sorted ranges and short runs, in time
    linear in the block and its settled pairs.
    """
    heads = members.groupBy("key").agg(F.min("account_id").alias("head"), F.max("account_id").alias("last"), F.count(F.lit(1)).alias("accounts"))
    heads = heads.where(F.col("head") < F.col("last")).select("key", "head")
    others = lookup(members.select("key", "account_id"), heads, "key")
    links = others.where(F.col("account_id") != F.col("head")).select("key", "account_id", F.col("head").alias("other_id"))
    pair = F.least("account_id", "other_id").alias("left_id"), F.greatest("account_id", "other_id").alias("right_id")
    if settled is None:
        return links.select(*pair).distinct()

    done = cut_lineage(settled.select("left_id", "right_id").distinct().select(F.inline(F.array(
        F.struct(F.col("left_id").alias("account_id"), F.col("right_id").alias("other_id")),
        F.struct(F.col("right_id").alias("account_id"), F.col("left_id").alias("other_id"))))), "settled")
    links = cut_lineage(links, "links")
    free = links.join(done, ["account_id", "other_id"], "left_anti")
    stuck = cut_lineage(links.join(done, ["account_id", "other_id"], "left_semi").select("key", "account_id"), "stuck")
    # A block's head needs a link of its own only when all links to it are settled.
    lone = heads.select("key", F.col("head").alias("account_id")).join(stuck.select("key").distinct(), "key", "left_semi").join(
        free.select("key", F.col("other_id").alias("account_id")).distinct(), ["key", "account_id"], "left_anti")
    stuck = cut_lineage(stuck.unionByName(lone), "stuck")
    inside = done.join(stuck.select("key", "account_id"), "account_id").join(
        members.select("key", F.col("account_id").alias("other_id")), ["key", "other_id"], "left_semi")
    inside = cut_lineage(inside.select("key", "account_id", "other_id"), "settled-inside")
    inside = inside.unionByName(stuck.select("key", "account_id", F.col("account_id").alias("other_id")))
    ranked = block_ranks(members.select("key", "account_id").join(stuck.select("key").distinct(), "key", "left_semi"))
    ranked = ranked.withColumnRenamed("account_id", "other_id")
    # A member skips itself and its settled pairs: the first rank that is not taken by them.
    taken = inside.join(ranked, ["key", "other_id"]).select("key", "account_id", "rank")
    wanted = first_free(taken, ["key", "account_id"], "rank")
    moved = wanted.join(ranked, ["key", "rank"]).select("key", "account_id", "other_id")
    return free.unionByName(moved).select(*pair).distinct()


def duplicate_candidates(leads: DataFrame, effective: DataFrame, masters: DataFrame | None = None,
                         decisions: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Links between candidate accounts with their best confidence, hold recommendation and all reasons, best first.

    Any two accounts of a block are candidates; the links join all accounts of a block, one link or less per account
    and block. With `decisions`, settled pairs are left out and every account that still has an open pair has a link.
    `members`, where at hand, are the leads' blocks.
    """
    if members is None:
        masters = masters if masters is not None else master_links(leads)
        members = cut_lineage(block_members(fingerprints(leads, effective), masters), "members")
    settled = None if decisions is None else latest_verdicts(decisions).where(F.col("decision") != "reopened")
    return describe_links(candidate_links(members, settled), members)


def describe_links(links: DataFrame, members: DataFrame) -> DataFrame:
    merged = is_candidate(links, members)
    return merged.select(
        t.pair_id(F.col("left_id"), F.col("right_id")).alias("pair_id"), "left_id", "right_id", "confidence",
        (F.col("confidence") >= HOLD_CONFIDENCE).alias("hold_recommended"), "reasons").orderBy(F.desc("confidence"), "pair_id")


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """How many links there are, and how many are strong enough to recommend a hold."""
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("hold_recommended").alias("strong"))


def block_sizes(members: DataFrame) -> DataFrame:
    """Accounts per blocking key, for a report on hot keys."""
    return members.groupBy("key").agg(F.first("reason").alias("reason"), F.count(F.lit(1)).alias("accounts"))


def _entries(decisions: DataFrame) -> DataFrame:
    """Decisions on two different leads whose pair id, if given, is that of the two."""
    a, b = F.col("lead_id"), F.col("other_lead_id")
    named = F.when(F.col("pair_id").isNotNull(), F.col("pair_id") == t.pair_id(a, b)).otherwise(True)
    return decisions.where((a != "") & (b != "") & (a != b) & named).withColumn("left_id", F.least(a, b)).withColumn(
        "right_id", F.greatest(a, b))


def latest_verdicts(decisions: DataFrame) -> DataFrame:
    """(left_id, right_id, decision) of the newest decision per pair, by a hash aggregate.

    Same order as `latest_decisions`, without carrying notes and reasons along.
    """
    names = F.array(F.lit("reopened"), F.lit("same"), F.lit("distinct"))
    side = (F.col("lead_id") > F.col("other_lead_id")).cast("decimal(1,0)")
    # The side goes between time and entry number; entry numbers below 10^18 leave it a digit.
    entry = side * F.lit("1000000000000000000").cast("decimal(19,0)") + F.col("seq").cast("decimal(18,0)")
    when = F.coalesce(F.unix_micros("reviewed_at"), F.lit(-10**17))
    newest = F.max(t.packed(when, entry, F.array_position(names, F.col("decision")) - 1))
    merged = _entries(decisions).groupBy("left_id", "right_id").agg(newest.alias("_newest"))
    return merged.select("left_id", "right_id", F.element_at(names, t.packed_code(F.col("_newest")) + 1).alias("decision"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Newest decision per pair: latest time (missing time is oldest), then latest entry.

    The reviews of the pair's smaller id count as entered first. A plain aggregate with map-side combine.
    """
    order = F.struct(
        F.coalesce(F.unix_micros("reviewed_at"), F.lit(-(2**62))),
        (F.col("lead_id") > F.col("other_lead_id")), F.col("seq"))
    value = F.struct("decision", "primary_lead_id", "reviewed_at", "note", "confidence", "reasons")
    merged = _entries(decisions).groupBy("left_id", "right_id").agg(F.max_by(value, order).alias("last"))
    return merged.select(t.pair_id(F.col("left_id"), F.col("right_id")).alias("pair_id"), "left_id", "right_id", "last.*")


def open_candidates(leads: DataFrame, effective: DataFrame, decisions: DataFrame, masters: DataFrame | None = None,
                    members: DataFrame | None = None) -> DataFrame:
    """Links for the pairs that nobody has settled (a reopened pair is open again)."""
    return duplicate_candidates(leads, effective, masters, decisions, members)


def standing_decisions(decisions: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs of existing leads whose newest decision stands, newest first."""
    ids = leads.select("lead_id")
    standing = latest_decisions(decisions).where(F.col("decision") != "reopened")
    known = lookup(standing, ids.withColumnRenamed("lead_id", "left_id"), "left_id").join(
        ids.withColumnRenamed("lead_id", "right_id"), "right_id", "left_semi")
    return known.orderBy(F.desc_nulls_last("reviewed_at"), "pair_id")


def is_candidate(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """For given pairs (left_id, right_id), the confidence and reasons of the keys they share.

    Answers for any pair without listing the pairs of a block: the keys of the account that has fewer are looked up
    among those of the other, so an account with very many keys is never written out per pair.
    """
    pairs = pairs.select("left_id", "right_id").distinct()
    wide = members.groupBy("account_id").agg(F.count(F.lit(1)).alias("keys"))
    sized = lookup(lookup(pairs, wide.select(F.col("account_id").alias("left_id"), F.col("keys").alias("left_keys")), "left_id"),
                   wide.select(F.col("account_id").alias("right_id"), F.col("keys").alias("right_keys")), "right_id")
    turned = F.col("left_keys") > F.col("right_keys")
    probes = sized.select("left_id", "right_id", F.when(turned, F.col("right_id")).otherwise(F.col("left_id")).alias("account_id"),
                          F.when(turned, F.col("left_id")).otherwise(F.col("right_id")).alias("other_id"))
    keyed = probes.join(members, "account_id").select("left_id", "right_id", "other_id", "key", "confidence", "reason")
    shared = keyed.join(members.select(F.col("account_id").alias("other_id"), "key"), ["other_id", "key"], "left_semi")
    return shared.groupBy("left_id", "right_id").agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def review_pairs(leads: DataFrame, effective: DataFrame, decisions: DataFrame, proposals: DataFrame,
                 masters: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Judge proposed decisions on pairs: `outcome` is accepted, deferred or the refusal code.

    Proposals: left_id, right_id, decision, primary_lead_id, note, reviewed_at, seq. A proposal is
    judged when it is the earliest of this batch for both its leads; later ones on the same leads depend
    on its result and come back as deferred, to be sent again after the accepted rows were appended.
    """
    if members is None:
        masters = masters if masters is not None else master_links(leads)
        members = cut_lineage(block_members(fingerprints(leads, effective), masters), "members")
    p = proposals.select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"),
        "decision", t.text("primary_lead_id").alias("primary_lead_id"), t.text("note").alias("note"),
        "reviewed_at", "seq")
    p = cut_lineage(p, "proposals")

    ends = p.select("seq", F.explode(F.array_distinct(F.array("left_id", "right_id"))).alias("end_id"))
    first_of_end = ends.groupBy("end_id").agg(F.min("seq").alias("first_seq"))
    early = lookup(ends, first_of_end, "end_id").groupBy("seq").agg(
        F.bool_and(F.col("seq") == F.col("first_seq")).alias("early"))

    def side(name: str) -> DataFrame:
        return leads.select(
            F.col("lead_id").alias(f"{name}_id"), F.lit(True).alias(f"{name}_known"),
            F.col("compliance.duplicate_of").alias(f"{name}_master"))

    last = latest_decisions(decisions).select(
        "left_id", "right_id", F.col("decision").alias("last_decision"),
        F.col("confidence").alias("last_confidence"), F.col("reasons").alias("last_reasons"))
    joined = lookup(lookup(p.join(early, "seq"), side("left"), "left_id", "left"), side("right"), "right_id", "left")
    joined = joined.join(last, ["left_id", "right_id"], "left").join(
        is_candidate(p, members), ["left_id", "right_id"], "left")

    settled = F.coalesce(F.col("last_decision") != "reopened", F.lit(False))
    in_pair = F.col("primary_lead_id").isin(F.col("left_id"), F.col("right_id"))

    def third(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.col(c).isin(F.col("left_id"), F.col("right_id"))

    refusal = first_code(
        (~F.coalesce(F.col("decision").isin("same", "distinct", "reopened"), F.lit(False)), "unknown-decision"),
        (F.coalesce(F.length("note"), F.lit(0)) < 3, "note-too-short"),
        (F.col("left_id") == F.col("right_id"), "same-lead"),
        (F.col("left_known").isNull() | F.col("right_known").isNull(), "unknown-lead"),
        ((F.col("decision") == "reopened") & ~settled, "nothing-to-reopen"),
        ((F.col("decision") != "reopened") & settled, "already-settled"),
        ((F.col("decision") != "reopened") & F.col("confidence").isNull(), "no-candidate"),
        ((F.col("decision") == "same") & ~F.coalesce(in_pair, F.lit(False)), "primary-not-in-pair"),
        ((F.col("decision") == "same") & (third("left_master") | third("right_master")), "belongs-to-other-master"),
    )
    outcome = F.when(~F.col("early"), "deferred").otherwise(F.coalesce(refusal, F.lit("accepted")))
    same = F.col("decision") == "same"
    return joined.select(
        "seq", t.pair_id(F.col("left_id"), F.col("right_id")).alias("pair_id"), "left_id", "right_id", "decision",
        F.when(same, F.col("primary_lead_id")).alias("primary_lead_id"),
        F.when(same, F.when(F.col("primary_lead_id") == F.col("left_id"), F.col("right_id")).otherwise(
            F.col("left_id"))).alias("secondary_lead_id"),
        "reviewed_at", "note",
        F.coalesce("confidence", "last_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("reasons", "last_reasons", F.array().cast("array<string>")).alias("reasons"),
        outcome.alias("outcome"))


def apply_reviews(leads: DataFrame, decisions: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leads with their new master links, and the decision log with both sides of each accepted row."""
    accepted = judged.where(F.col("outcome") == "accepted")
    sides = F.array(
        F.struct(F.col("left_id").alias("lead_id"), F.col("right_id").alias("other_lead_id")),
        F.struct(F.col("right_id").alias("lead_id"), F.col("left_id").alias("other_lead_id")))
    log = accepted.select(
        "pair_id", F.inline(sides), "decision", "primary_lead_id", "reviewed_at", "note", "confidence", "reasons", "seq")
    # One accepted row per lead and batch, so this stays one row per lead.
    change = log.select(
        "lead_id", "other_lead_id",
        F.when((F.col("decision") == "same") & (F.col("primary_lead_id") != F.col("lead_id")),
               F.col("primary_lead_id")).alias("new_master"))
    joined = leads.join(change, "lead_id", "left")
    old = F.col("compliance.duplicate_of")
    inside = old.isin(F.col("lead_id"), F.col("other_lead_id"))
    master = F.when(F.col("other_lead_id").isNull(), old).otherwise(
        F.coalesce("new_master", F.when(~F.coalesce(inside, F.lit(False)), old)))
    updated = joined.withColumn("compliance", F.col("compliance").withField("duplicate_of", master))
    return updated.select(*leads.columns), decisions.unionByName(log.select(*decisions.columns))


def _reach(leads: DataFrame, ends: DataFrame) -> DataFrame:
    """(lead_id) of the leads whose master may change when the `ends` (lead_id) are linked or parted: all of their groups.

    Groups that share a cycle have several masters, so every group of a cycle is taken.
    """
    masters = cut_lineage(master_links(leads), "masters")
    grouped = leads.select("lead_id").join(masters, "lead_id", "left").select("lead_id", F.coalesce("master_id", "lead_id").alias("group"))
    met = grouped.join(ends, "lead_id", "left_semi").select("group").union(masters.where("lead_id = master_id").select("master_id"))
    return cut_lineage(grouped.join(met.distinct(), "group", "left_semi").select("lead_id"), "reach")


def review_all(leads: DataFrame, effective: DataFrame, decisions: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judge and apply a batch to the end: as many passes as the longest chain of dependent proposals.

    A pass judges all proposals that come first for both their leads. Passes work on what the batch can touch: the groups of its
    leads, their blocking keys (made once) and the decisions on its pairs. Masters are followed again only after a pass
    that moved one. All leads and decisions are read before the first pass and after the last.
    """
    proposals = cut_lineage(proposals, "proposals")
    ends = proposals.select(F.explode(F.array("left_id", "right_id")).alias("lead_id")).distinct()
    reach = _reach(leads, ends)
    state = cut_lineage(leads.select("lead_id", "compliance").join(reach, "lead_id", "left_semi"), "state")
    keys = cut_lineage(fingerprints(leads.join(reach, "lead_id", "left_semi"), effective.join(reach, "lead_id", "left_semi")), "keys")
    sides = proposals.select(F.inline(F.array(
        F.struct(F.col("left_id").alias("lead_id"), F.col("right_id").alias("other_lead_id")),
        F.struct(F.col("right_id").alias("lead_id"), F.col("left_id").alias("other_lead_id"))))).distinct()
    log = cut_lineage(decisions.join(sides, ["lead_id", "other_lead_id"], "left_semi").select(*decisions.columns), "log")
    none, waiting, moved, done = log.limit(0), proposals, True, []
    added: list[DataFrame] = []
    while True:
        if moved:
            members = cut_lineage(block_members(keys, master_links(state)), "members")
        judged = cut_lineage(review_pairs(state, effective, log, waiting, members=members), "judged")
        done.append(judged.where(F.col("outcome") != "deferred"))
        changed, entries = apply_reviews(state, none, judged)
        added.append(cut_lineage(entries, "entries"))
        before = state.select("lead_id", F.col("compliance.duplicate_of").alias("_before"))
        changed = cut_lineage(changed, "state")
        moved = not changed.join(before, "lead_id").where(~F.col("compliance.duplicate_of").eqNullSafe(F.col("_before"))).isEmpty()
        state, log = changed, log.unionByName(added[-1])
        left = judged.where(F.col("outcome") == "deferred").select("seq")
        if left.isEmpty():
            break
        waiting = proposals.join(left, "seq", "left_semi")
    masters = state.select("lead_id", F.lit(True).alias("_known"), F.col("compliance.duplicate_of").alias("_master"))
    standing = F.when(F.col("_known"), F.col("compliance").withField("duplicate_of", F.col("_master"))).otherwise(F.col("compliance"))
    new = leads.join(masters, "lead_id", "left").withColumn("compliance", standing).select(*leads.columns)
    return new, functools.reduce(DataFrame.unionByName, added, decisions), functools.reduce(DataFrame.unionByName, done)
