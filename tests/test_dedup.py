import random

import pytest
from pyspark.sql import functions as F

from leadloom import model
from leadloom.functions import text as t
from leadloom.operators import dedup, evidence as ev, scoring
from leadloom.session import lookup
from tests.fixtures import leads, rows

PRIMARY = {"id": "lead-primary", "source": "Alibaba", "sourceReference": "DEMO-A",
           "organization": {"name": "Velmora Home Goods", "domain": "velmora.example"},
           "inquiry": {"product": "Enamel lantern", "quantity": "2000"}, "signals": {"explicitInquiry": True}}
SECONDARY = {"id": "lead-secondary", "source": "Made-in-China", "sourceReference": "DEMO-B",
             "organization": {"name": "Velmora Imports Ltd", "website": "https://velmora.example/about"},
             "contact": {"email": "sourcing@velmora.example"}, "inquiry": {"message": "Please send a catalog", "product": "Bottle"}}


def effective(tables):
    return scoring.effective_evidence(tables.evidence, tables.reviews)


def proposals(spark, *items):
    return spark.createDataFrame(
        [("lead-primary", "lead-secondary", d, p, note, at, i + 1) for i, (d, p, note, at) in enumerate(items)],
        "left_id string, right_id string, decision string, primary_lead_id string, note string, reviewed_at string, seq bigint"
    ).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))


def judge(spark, tables, *items):
    return dedup.review_all(tables.leads, effective(tables), tables.decisions, proposals(spark, *items))


def open_pairs(new_leads, evidence, decisions):
    return rows(dedup.open_candidates(new_leads, evidence, decisions))


def test_same_domain_is_a_strong_match(spark, tmp_path):
    tables = leads(spark, tmp_path, [
        {"id": "a", "organization": {"name": "Demo Buyer", "country": "Norvania", "website": "https://buyer.example/about"}},
        {"id": "b", "organization": {"name": "Demo Buyer", "country": "Norvania", "domain": "buyer.example"}}])
    found = rows(dedup.duplicate_candidates(tables.leads, effective(tables)))
    assert len(found) == 1 and found[0]["confidence"] == 0.95 and found[0]["hold_recommended"]
    assert found[0]["reasons"] == ["same-domain", "same-name-and-country"]


def test_same_decision_links_and_holds_the_secondary(spark, tmp_path):
    tables = leads(spark, tmp_path, [PRIMARY, SECONDARY])
    new, log, judged = judge(spark, tables, ("same", "lead-primary", "domain and entity agree", "2026-09-08T06:00:00Z"))
    assert [r.outcome for r in judged.collect()] == ["accepted"]
    master = {r.lead_id: r.compliance.duplicate_of for r in new.collect()}
    assert master == {"lead-primary": None, "lead-secondary": "lead-primary"}
    grades = {r.lead_id: r.grade for r in scoring.qualify(new, effective(tables)).collect()}
    assert grades["lead-secondary"] == "HOLD"
    assert open_pairs(new, effective(tables), log) == []
    assert [(d["decision"], d["primary_lead_id"]) for d in rows(dedup.standing_decisions(log, new))] == [("same", "lead-primary")]


def test_reopening_restores_the_candidate_and_keeps_the_log(spark, tmp_path):
    tables = leads(spark, tmp_path, [PRIMARY, SECONDARY])
    new, log, judged = judge(spark, tables, ("same", "lead-primary", "domain and entity agree", "2026-09-08T06:00:00Z"),
                             ("reopened", None, "registration to be checked", "2026-09-08T06:05:00Z"))
    assert {r.outcome for r in judged.collect()} == {"accepted"}
    assert log.where("lead_id = 'lead-primary'").count() == 2
    assert all(r.compliance.duplicate_of is None for r in new.collect())
    assert len(open_pairs(new, effective(tables), log)) == 1 and rows(dedup.standing_decisions(log, new)) == []


def test_distinct_decision_suppresses_without_hold(spark, tmp_path):
    tables = leads(spark, tmp_path, [PRIMARY, SECONDARY])
    new, log, _ = judge(spark, tables, ("distinct", None, "two buyers of one group", "2026-09-08T06:10:00Z"))
    assert all(r.compliance.duplicate_of is None for r in new.collect())
    assert open_pairs(new, effective(tables), log) == []


@pytest.mark.parametrize("item, code", [
    (("same", "lead-primary", "x", None), "note-too-short"),
    (("same", None, "confirmed by hand", None), "primary-not-in-pair"),
    (("reopened", None, "not decided yet", None), "nothing-to-reopen"),
    (("merge", None, "not a decision", None), "unknown-decision")])
def test_bad_proposals_are_refused(spark, tmp_path, item, code):
    tables = leads(spark, tmp_path, [PRIMARY, SECONDARY])
    judged = dedup.review_pairs(tables.leads, effective(tables), tables.decisions, proposals(spark, item))
    assert judged.first().outcome == code


def test_member_of_another_master_is_refused(spark, tmp_path):
    chained = {**SECONDARY, "compliance": {"duplicateOf": "lead-third-master"}}
    tables = leads(spark, tmp_path, [PRIMARY, chained])
    judged = dedup.review_pairs(tables.leads, effective(tables), tables.decisions,
                                proposals(spark, ("same", "lead-primary", "a new master", None)))
    assert judged.first().outcome == "belongs-to-other-master"


def test_secondary_gives_its_fingerprints_to_the_master(spark, tmp_path):
    mail = [{"kind": "business-email", "value": "sourcing@velmora.example", "sourceRef": "https://velmora.example/contact", "status": "verified"}]
    tables = leads(spark, tmp_path, [
        PRIMARY, {**SECONDARY, "compliance": {"duplicateOf": "lead-primary"}, "evidence": mail},
        {"id": "lead-third", "organization": {"name": "Different spelling"}, "evidence": mail}])
    found = rows(dedup.duplicate_candidates(tables.leads, effective(tables)))
    assert [(f["left_id"], f["right_id"]) for f in found] == [("lead-primary", "lead-third")]
    assert "same-verified-email" in found[0]["reasons"]


def test_rejected_evidence_gives_no_fingerprint(spark, tmp_path):
    mail = {"id": "shared", "kind": "business-email", "value": "shared@example.com", "sourceRef": "registry:demo", "status": "verified"}
    tables = leads(spark, tmp_path, [{"id": "first", "organization": {"name": "First Demo"}, "evidence": [mail]},
                                     {"id": "second", "organization": {"name": "Second Demo"}, "evidence": [{**mail, "id": "own"}]}])
    assert dedup.duplicate_candidates(tables.leads, effective(tables)).count() == 1
    action = spark.createDataFrame([("first", "shared", 1, "rejected", "not their address", None, None)],
                                   "lead_id string, evidence_id string, seq bigint, action string, note string, value string, source_ref string"
                                   ).withColumn("reviewed_at", F.lit("2026-09-08T05:00:00Z").cast("timestamp"))
    done = ev.review_evidence(tables.leads, tables.evidence, tables.reviews, tables.origins, action)
    kept = scoring.effective_evidence(done["evidence"], done["reviews"])
    assert dedup.duplicate_candidates(done["leads"], kept).count() == 0


def members(spark, blocks):
    data = [(k, a, 0.95, "same-domain") for k, accounts in blocks.items() for a in accounts]
    random.Random(5).shuffle(data)
    return spark.createDataFrame(data, "key string, account_id string, confidence double, reason string")


def links_by_hand(blocks, settled=()):
    """Each account of each block with the first other one it has no settled decision with."""
    out = set()
    for accounts in blocks.values():
        for own in accounts:
            other = [x for x in sorted(accounts) if x != own and (min(x, own), max(x, own)) not in settled]
            out |= {(min(own, x), max(own, x)) for x in other[:1]}
    return out


def pair_frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "left_id string, right_id string")


def test_every_account_of_a_block_has_one_link(spark):
    blocks = {"hot": [f"a{i:03}" for i in range(120)], "small": ["a003", "b1", "b2"], "single": ["z"]}
    got = {(r.left_id, r.right_id) for r in dedup.candidate_links(members(spark, blocks)).collect()}
    assert got == links_by_hand(blocks) == {("a000", f"a{i:03}") for i in range(1, 120)} | {("a003", "b1"), ("a003", "b2")}


def test_settled_pairs_move_links_instead_of_losing_them(spark):
    blocks = {"hot": [f"a{i:02}" for i in range(20)], "other": ["a05", "a19", "c1"], "done": ["x", "y"]}
    head = {("a00", f"a{i:02}") for i in range(1, 20)}
    for settled in ({("a00", "a19")}, head, head | {("a01", f"a{i:02}") for i in range(2, 20, 2)} | {("x", "y")}, {("a05", "a19"), ("a19", "c1"), ("x", "y")}):
        got = {(r.left_id, r.right_id) for r in dedup.candidate_links(members(spark, blocks), pair_frame(spark, settled)).collect()}
        assert got == links_by_hand(blocks, settled)
        assert not got & settled


def test_links_of_random_blocks(spark):
    rnd = random.Random(7)
    blocks = {f"k{i}": rnd.sample([f"n{j:02}" for j in range(60)], rnd.randint(1, 12)) for i in range(25)}
    every = {(min(a, b), max(a, b)) for accounts in blocks.values() for a in accounts for b in accounts if a != b}
    settled = set(rnd.sample(sorted(every), len(every) // 2))
    got = {(r.left_id, r.right_id) for r in dedup.candidate_links(members(spark, blocks), pair_frame(spark, settled)).collect()}
    assert got == links_by_hand(blocks, settled)


def test_pairs_can_be_checked_without_listing_them(spark):
    data = members(spark, {"hot": [f"a{i}" for i in range(100)], "x": ["a1", "q"]})
    pairs = spark.createDataFrame([("a98", "a99"), ("a1", "q"), ("a2", "q")], "left_id string, right_id string")
    assert {(r.left_id, r.right_id) for r in dedup.is_candidate(pairs, data).collect()} == {("a98", "a99"), ("a1", "q")}


def walk(links):
    out = {}
    for start in links:
        seen, current = set(), start
        while current in links and current not in seen:
            seen.add(current)
            current = links[current]
        out[start] = current
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_master_links_equal_a_plain_walk(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(80)]
    links = {i: rnd.choice(ids) for i in ids if rnd.random() < 0.9}
    links.update({"c0": "c1", **{f"c{i}": f"c{i + 1}" for i in range(40)}})
    every = sorted(set(ids) | set(links) | set(links.values()))
    df = spark.createDataFrame([(i, links.get(i, "gone" if i == "n1" else None)) for i in every], "lead_id string, duplicate_of string")
    links = {k: v for k, v in links.items() if v in every}
    got = {r.lead_id: r.master_id for r in dedup.master_links(df.select("lead_id", F.struct("duplicate_of").alias("compliance"))).collect()}
    assert got == walk(links)


def test_latest_decision_order(spark):
    at = "2026-01-01 00:00:00"
    log = [("a", "b", "same", at, 1), ("b", "a", "distinct", at, 1), ("a", "b", "reopened", None, 9),
           ("a", "c", "same", None, 1), ("a", "c", "distinct", None, 2), ("a", "a", "same", at, 3)]
    df = spark.createDataFrame([(None, l, o, d, l, ts, "note", 0.5, [], s) for l, o, d, ts, s in log],
                               "pair_id string, lead_id string, other_lead_id string, decision string, primary_lead_id string, ts string, "
                               "note string, confidence double, reasons array<string>, seq bigint").withColumn("reviewed_at", F.col("ts").cast("timestamp"))
    got = {r.pair_id: r.decision for r in dedup.latest_decisions(df).collect()}
    assert got == {"duplicate:a:b": "distinct", "duplicate:a:c": "distinct"}


def test_pair_ids_are_encoded_and_ordered(spark):
    df = spark.createDataFrame([("b c", "a/é"), ("x", "x"), ("", "y")], "l string, r string")
    got = [r[0] for r in df.select(t.pair_id(F.col("l"), F.col("r"))).collect()]
    assert got == ["duplicate:a%2F%C3%A9:b%20c", None, None]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_equals_a_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 700).alias("k"))
    right = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    same = lambda df: sorted(tuple(r) for r in df.select("id", "k", "v").fillna(-1).collect())
    assert same(lookup(left, right, "k", how)) == same(left.join(right, "k", how))


def test_lookup_refuses_a_second_row_per_key(spark):
    left, right = spark.range(5).withColumnRenamed("id", "k"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="not unique"):
        lookup(left, right, "k").collect()


def test_candidates_do_not_depend_on_partitioning(spark, tmp_path):
    docs = [{"id": f"l{i}", "source": "s", "organization": {"name": f"N{i % 7}", "country": "X", "domain": f"d{i % 5}.example"}} for i in range(25)]
    tables = leads(spark, tmp_path, docs)
    one = rows(dedup.duplicate_candidates(tables.leads.repartition(1), effective(tables)), "pair_id")
    assert one == rows(dedup.duplicate_candidates(tables.leads.repartition(7), effective(tables)), "pair_id")
    blocks = {("name", k): [f"l{i}" for i in range(25) if i % 7 == k] for k in range(7)} | {("domain", k): [f"l{i}" for i in range(25) if i % 5 == k] for k in range(5)}
    assert {(r["left_id"], r["right_id"]) for r in one} == links_by_hand(blocks)


def test_model_has_every_lead_path():
    assert len(model.FIELD_PATHS) == 14


def test_first_free_number_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "RUN", 4)
    groups = {"a": [1, 2, 3], "b": [2, 3], "c": list(range(1, 13)), "d": [*range(1, 9), 13, 14], "e": [*range(1, 7), 8, 9], "f": [5, 6, 7, 8], "g": [1, 1, 2, 4]}
    rows = [(k, n) for k, ns in groups.items() for n in ns]
    got = {r.key: r.n for r in dedup.first_free(spark.createDataFrame(rows, "key string, n long"), ["key"], "n").collect()}
    assert got == {k: next(i for i in range(1, 20) if i not in ns) for k, ns in groups.items()}
    members = spark.createDataFrame([(k, f"{i * 7 % 50:02}") for k in "xyz" for i in range(50)], "key string, account_id string")
    assert {(r.key, r.account_id): r["rank"] for r in dedup.block_ranks(members).collect()} == {(k, f"{i:02}"): i + 1 for k in "xyz" for i in range(50)}


def test_a_reopened_pair_takes_its_whole_group_apart_again(spark, tmp_path):
    child = {"id": "lead-child", "organization": {"name": "Third"}, "compliance": {"duplicateOf": "lead-secondary"}}
    tables = leads(spark, tmp_path, [PRIMARY, SECONDARY, child, {"id": "aside", "organization": {"name": "Aside"}}])
    new, log, judged = judge(spark, tables, ("same", "lead-primary", "domain agrees", "2026-09-08"), ("reopened", None, "looked again", "2026-09-09"),
                             ("same", "lead-secondary", "other way round", "2026-09-10"))
    assert [r.outcome for r in judged.orderBy("seq").collect()] == ["accepted"] * 3
    assert {r.lead_id: r.master_id for r in dedup.master_links(new).collect()} == {"lead-primary": "lead-secondary", "lead-child": "lead-secondary"}
    assert new.count() == 4 and log.count() == 6
