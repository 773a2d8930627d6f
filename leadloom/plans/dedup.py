"""Queries: blocking keys, duplicate candidates, decisions, master links."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import dedup, scoring
from leadloom.plans.base import (
    EFFECTIVE, EVIDENCE, LEADS, REVIEWS, derive, evidence_frame, lead_frame, query, review_frame, time_text, with_parts)
from leadloom.session import cut_lineage

LEAD_PARTS = {"leads": LEADS, "evidence": EVIDENCE, "reviews": REVIEWS, "effective": EFFECTIVE}

FINGERPRINTS = r"""
SELECT lead_id, 'source:' || source || ':' || source_reference AS key, 1.0::DOUBLE AS confidence,
  'same-source-reference' AS reason FROM leads WHERE source_reference IS NOT NULL
UNION ALL SELECT lead_id, 'registration:' || lower(registration_id), 1.0, 'same-registration' FROM leads WHERE registration_id IS NOT NULL
UNION ALL SELECT lead_id, 'domain:' || regexp_replace(regexp_extract(lower(coalesce(domain, website)), '^(https?://)?([^/]+)', 2), '^www\.', ''),
  0.95, 'same-domain' FROM leads WHERE coalesce(domain, website) IS NOT NULL
UNION ALL SELECT lead_id, 'name-country:' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g') || ':'
  || regexp_replace(lower(country), '[^a-z0-9]', '', 'g'), 0.7, 'same-name-and-country' FROM leads WHERE name IS NOT NULL
UNION ALL SELECT lead_id, 'email:' || lower(trim(value)), 0.95, 'same-verified-email' FROM effective
  WHERE kind IN ('business-email', 'work-email') AND status = 'verified'
"""

MASTERS = """
SELECT lead_id, arg_max(node, depth) AS master_id FROM walk GROUP BY lead_id
"""
WALK = """
SELECT l.lead_id, p.lead_id AS node, 1 AS depth FROM leads l JOIN leads p ON l.duplicate_of = p.lead_id
UNION ALL SELECT w.lead_id, p.lead_id, w.depth + 1 FROM walk w JOIN leads n ON n.lead_id = w.node JOIN leads p ON n.duplicate_of = p.lead_id
"""
MEMBERS = """
SELECT DISTINCT key, coalesce(master_id, f.lead_id) AS account_id, confidence, reason
FROM fingerprints f LEFT JOIN masters m ON m.lead_id = f.lead_id
"""
# The rule itself: any two accounts of a block are candidates; settled pairs are not open.
ALL_PAIRS = """
SELECT a.account_id AS left_id, b.account_id AS right_id, a.key, a.confidence, a.reason
FROM members a JOIN members b ON a.key = b.key AND a.account_id < b.account_id
"""


def listed(pairs: str) -> str:
    """Of all pairs: each account's first one in each block."""
    return f"""
SELECT 'duplicate:' || left_id || ':' || right_id AS pair_id, left_id, right_id, max(confidence) AS confidence,
  max(confidence) >= 0.95 AS hold_recommended, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons
FROM all_pairs WHERE (left_id, right_id) IN (
  SELECT least(own, other), greatest(own, other) FROM (
    SELECT key, own, min(other) AS other FROM (
      SELECT key, left_id AS own, right_id AS other FROM {pairs} UNION ALL SELECT key, right_id, left_id FROM {pairs}) GROUP BY key, own))
GROUP BY left_id, right_id
"""


CANDIDATES = listed("all_pairs")
OPEN_PAIRS = """
SELECT * FROM all_pairs p WHERE NOT EXISTS (SELECT 1 FROM latest d WHERE d.left_id = p.left_id AND d.right_id = p.right_id AND d.decision <> 'reopened')
"""
CANDIDATE_PARTS = {**LEAD_PARTS, "fingerprints": FINGERPRINTS, "walk": WALK, "masters": MASTERS, "members": MEMBERS, "all_pairs": ALL_PAIRS}

SUMMARY = """
SELECT count(*) AS candidates, count(*) FILTER (hold_recommended) AS strong FROM candidates
"""


@query("dup_summary", with_parts(SUMMARY, **CANDIDATE_PARTS, candidates=CANDIDATES))
def dup_summary(spark, folder):
    return dedup.candidate_summary(candidates(spark, folder))


# Decisions on pairs of neighbours, several per pair, entered from either side.
DECISIONS = """
SELECT concat('L', lpad(CAST(o_custkey AS STRING), 9, '0')) AS a_id, concat('L', lpad(CAST(o_custkey + 1 AS STRING), 9, '0')) AS b_id,
  CASE o_orderstatus WHEN 'F' THEN 'same' WHEN 'O' THEN 'distinct' ELSE 'reopened' END AS decision,
  CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS reviewed_at, o_orderkey AS seq, o_orderkey % 2 = 0 AS by_left
FROM orders WHERE o_custkey + 1 < (SELECT count(*) FROM customer)
"""
LATEST = """
SELECT 'duplicate:' || a_id || ':' || b_id AS pair_id, a_id AS left_id, b_id AS right_id, decision, reviewed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY reviewed_at DESC NULLS LAST, NOT by_left DESC, seq DESC) AS rn
  FROM decisions) WHERE rn = 1
"""


def decision_frame(spark: SparkSession, folder: str) -> DataFrame:
    rows = derive(spark, folder, DECISIONS)
    return rows.select(
        F.lit(None).cast("string").alias("pair_id"), F.when(F.col("by_left"), F.col("a_id")).otherwise(F.col("b_id")).alias("lead_id"),
        F.when(F.col("by_left"), F.col("b_id")).otherwise(F.col("a_id")).alias("other_lead_id"), "decision",
        F.when(F.col("decision") == "same", F.col("a_id")).alias("primary_lead_id"),
        F.col("reviewed_at").cast("timestamp").alias("reviewed_at"), F.lit("derived decision").alias("note"),
        F.lit(0.5).alias("confidence"), F.array(F.lit("same-domain")).alias("reasons"), "seq")


def effective(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.effective_evidence(evidence_frame(spark, folder), review_frame(spark, folder))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_candidates(lead_frame(spark, folder), effective(spark, folder))


@query("dup_fingerprints", with_parts("SELECT * FROM fingerprints", **LEAD_PARTS, fingerprints=FINGERPRINTS))
def dup_fingerprints(spark, folder):
    return dedup.fingerprints(lead_frame(spark, folder), effective(spark, folder))


@query("dup_block_sizes", with_parts(
    "SELECT key, any_value(reason) AS reason, count(*) AS accounts FROM members GROUP BY key", **LEAD_PARTS,
    fingerprints=FINGERPRINTS, walk=WALK, masters=MASTERS, members=MEMBERS))
def dup_block_sizes(spark, folder):
    leads = lead_frame(spark, folder)
    return dedup.block_sizes(dedup.block_members(
        dedup.fingerprints(leads, effective(spark, folder)), dedup.master_links(leads)))


@query("dup_candidates", with_parts("SELECT * FROM candidates", **CANDIDATE_PARTS, candidates=CANDIDATES))
def dup_candidates(spark, folder):
    return candidates(spark, folder)


@query("dup_latest_decision", with_parts(
    f"SELECT pair_id, left_id, right_id, decision, {time_text('reviewed_at')} AS reviewed_at FROM latest",
    decisions=DECISIONS, latest=LATEST))
def dup_latest_decision(spark, folder):
    return dedup.latest_decisions(decision_frame(spark, folder)).select(
        "pair_id", "left_id", "right_id", "decision", "reviewed_at")


@query("dup_standing_decisions", with_parts(
    f"SELECT pair_id, decision, {time_text('reviewed_at')} AS reviewed_at FROM latest WHERE decision <> 'reopened'",
    decisions=DECISIONS, latest=LATEST))
def dup_standing_decisions(spark, folder):
    return dedup.standing_decisions(decision_frame(spark, folder), lead_frame(spark, folder)).select(
        "pair_id", "decision", "reviewed_at")


# The first account of the largest blocks has decisions with many of its members, so links have to move on.
HEAD_DECISIONS = DECISIONS + """
UNION ALL SELECT head, account_id, 'distinct', CAST('2024-01-01' AS TIMESTAMP), 900000000 + row_number() OVER (ORDER BY head, account_id), TRUE FROM (
  SELECT DISTINCT k.head, m.account_id FROM members m JOIN (SELECT key, min(account_id) AS head FROM members GROUP BY key HAVING count(*) > 2) k
  ON k.key = m.key WHERE m.account_id <> k.head AND CAST(substring(m.account_id, 2) AS BIGINT) % 3 = 0)
"""


@query("dup_open", with_parts("SELECT * FROM open_candidates", **CANDIDATE_PARTS, decisions=HEAD_DECISIONS, latest=LATEST, open_pairs=OPEN_PAIRS,
                              open_candidates=listed("open_pairs").replace("FROM all_pairs WHERE", "FROM open_pairs WHERE")))
def dup_open(spark, folder):
    leads, known = lead_frame(spark, folder), effective(spark, folder)
    masters = dedup.master_links(leads)
    members = cut_lineage(dedup.block_members(dedup.fingerprints(leads, known), masters), "members")
    heads = members.groupBy("key").agg(F.min("account_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 2")
    extra = members.join(heads, "key").where("account_id <> head AND CAST(substring(account_id, 2) AS BIGINT) % 3 = 0").select("head", "account_id").distinct()
    base = decision_frame(spark, folder)
    more = extra.select(
        F.lit(None).cast("string").alias("pair_id"), F.col("head").alias("lead_id"), F.col("account_id").alias("other_lead_id"), F.lit("distinct").alias("decision"),
        F.lit(None).cast("string").alias("primary_lead_id"), F.lit("2024-01-01").cast("timestamp").alias("reviewed_at"), F.lit("derived decision").alias("note"),
        F.lit(0.5).alias("confidence"), F.array(F.lit("same-domain")).alias("reasons"), F.lit(900000000).cast("long").alias("seq"))
    return dedup.open_candidates(leads, known, base.unionByName(more.select(*base.columns)), masters, members)


# A third of all leads points straight at lead 0; the others form chains by halving and a few cycles.
LINK_LEADS = """
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS lead_id,
  CASE WHEN c_custkey = 0 THEN NULL
       WHEN c_custkey % 3 = 0 THEN 'L000000000'
       WHEN c_custkey % 50 = 1 THEN concat('L', lpad(CAST(c_custkey + 1 AS STRING), 9, '0'))
       WHEN c_custkey % 50 = 2 THEN concat('L', lpad(CAST(c_custkey - 1 AS STRING), 9, '0'))
       WHEN c_custkey % 50 = 5 THEN concat('L', lpad(CAST(c_custkey AS STRING), 9, '0'))
       WHEN c_custkey % 50 = 7 THEN 'missing'
       ELSE concat('L', lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING), 9, '0')) END AS duplicate_of
FROM customer
"""


@query("master_links", with_parts("""
SELECT lead_id, CASE WHEN stop_at IS NOT NULL THEN stop_at ELSE node END AS master_id FROM (
  SELECT lead_id, arg_max(node, depth) AS node, arg_max(stop_at, depth) AS stop_at FROM walk GROUP BY lead_id)""",
    leads=LINK_LEADS, walk="""
SELECT l.lead_id, p.lead_id AS node, [l.lead_id] AS seen, 1 AS depth, CASE WHEN p.lead_id = l.lead_id THEN p.lead_id END AS stop_at
FROM leads l JOIN leads p ON l.duplicate_of = p.lead_id
UNION ALL SELECT w.lead_id, p.lead_id, list_append(w.seen, w.node), w.depth + 1,
  CASE WHEN list_contains(list_append(w.seen, w.node), p.lead_id) THEN p.lead_id END
FROM walk w JOIN leads n ON n.lead_id = w.node JOIN leads p ON n.duplicate_of = p.lead_id WHERE w.stop_at IS NULL"""))
def master_links(spark, folder):
    rows = derive(spark, folder, LINK_LEADS)
    return dedup.master_links(rows.select("lead_id", F.struct("duplicate_of").alias("compliance")))


# Every lead proposes a decision on its neighbour, some on a lead further away, some without a reason.
PROPOSALS = """
SELECT least(own_id, other_id) AS left_id, greatest(own_id, other_id) AS right_id, decision, primary_lead_id, note, seq FROM (
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS own_id,
  concat('L', lpad(CAST(CASE WHEN c_custkey % 10 = 8 THEN c_custkey + 9 WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END AS STRING), 9, '0')) AS other_id,
  CASE c_custkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'distinct' ELSE 'reopened' END AS decision,
  CASE WHEN c_custkey % 30 <> 6 THEN concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) END AS primary_lead_id,
  CASE WHEN c_custkey % 20 = 4 THEN 'x' ELSE 'checked by hand' END AS note, c_custkey AS seq
FROM customer) p
"""


@query("dup_review_outcomes", with_parts("""
SELECT p.seq, p.left_id, p.right_id, p.decision, CASE
  WHEN NOT early THEN 'deferred' WHEN length(p.note) < 3 THEN 'note-too-short' WHEN l.lead_id IS NULL OR r.lead_id IS NULL THEN 'unknown-lead'
  WHEN p.decision = 'reopened' AND coalesce(d.decision, 'reopened') = 'reopened' THEN 'nothing-to-reopen'
  WHEN p.decision <> 'reopened' AND coalesce(d.decision, 'reopened') <> 'reopened' THEN 'already-settled'
  WHEN p.decision <> 'reopened' AND NOT EXISTS (SELECT 1 FROM members a JOIN members b ON a.key = b.key
    WHERE a.account_id = p.left_id AND b.account_id = p.right_id) THEN 'no-candidate'
  WHEN p.decision = 'same' AND p.primary_lead_id IS NULL THEN 'primary-not-in-pair'
  WHEN p.decision = 'same' AND (coalesce(l.duplicate_of, p.left_id) NOT IN (p.left_id, p.right_id)
    OR coalesce(r.duplicate_of, p.left_id) NOT IN (p.left_id, p.right_id)) THEN 'belongs-to-other-master'
  ELSE 'accepted' END AS outcome
FROM proposals p JOIN early e ON e.seq = p.seq LEFT JOIN leads l ON l.lead_id = p.left_id LEFT JOIN leads r ON r.lead_id = p.right_id
LEFT JOIN latest d ON d.left_id = p.left_id AND d.right_id = p.right_id""",
    **LEAD_PARTS, fingerprints=FINGERPRINTS, walk=WALK, masters=MASTERS, members=MEMBERS, decisions=DECISIONS, latest=LATEST,
    proposals=PROPOSALS, ends="SELECT seq, left_id AS id FROM proposals UNION ALL SELECT seq, right_id FROM proposals",
    early="""SELECT e.seq, bool_and(e.seq = f.first) AS early FROM ends e JOIN (SELECT id, min(seq) AS first FROM ends GROUP BY id) f
      ON f.id = e.id GROUP BY e.seq"""))
def dup_review_outcomes(spark, folder):
    proposals = derive(spark, folder, PROPOSALS).withColumn("reviewed_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    judged = dedup.review_pairs(lead_frame(spark, folder), effective(spark, folder), decision_frame(spark, folder), proposals)
    return judged.select("seq", "left_id", "right_id", "decision", "outcome")


# Neighbours get four proposals each, in turn; a later one depends on what became of the earlier ones. `near` says whether two
# neighbours share a key while neither is the other's master; a decision that parts them makes them candidates again.
CHAINS = """
SELECT concat('L', lpad(CAST(c_custkey AS STRING), 9, '0')) AS left_id, concat('L', lpad(CAST(c_custkey + 1 AS STRING), 9, '0')) AS right_id,
  CASE WHEN turn = 2 OR (c_custkey + turn) % 7 = 0 THEN 'reopened' WHEN (c_custkey + turn) % 4 = 0 THEN 'distinct' ELSE 'same' END AS decision,
  CASE WHEN (c_custkey + turn) % 30 <> 6 THEN concat('L', lpad(CAST(c_custkey + (c_custkey + turn) % 2 AS STRING), 9, '0')) END AS primary_lead_id,
  CASE WHEN (c_custkey + turn) % 20 = 4 THEN 'x' ELSE 'checked by hand' END AS note, c_custkey * 10 + turn AS seq, turn
FROM (SELECT c_custkey, each_of(1, 2, 3, 4) AS turn FROM customer WHERE c_custkey % 2 = 0) c
"""
CHAIN_PAIRS = """
SELECT p.left_id, p.right_id, l.lead_id IS NOT NULL AND r.lead_id IS NOT NULL AS known, l.duplicate_of AS left_master, r.duplicate_of AS right_master,
  coalesce(d.decision, 'reopened') <> 'reopened' AS settled,
  CASE WHEN l.duplicate_of = p.right_id OR r.duplicate_of = p.left_id
    THEN EXISTS (SELECT 1 FROM fingerprints a JOIN fingerprints b ON a.key = b.key WHERE a.lead_id = p.left_id AND b.lead_id = p.right_id)
    ELSE EXISTS (SELECT 1 FROM members a JOIN members b ON a.key = b.key WHERE a.account_id = p.left_id AND b.account_id = p.right_id) END AS near
FROM (SELECT DISTINCT left_id, right_id FROM chains) p LEFT JOIN leads l ON l.lead_id = p.left_id LEFT JOIN leads r ON r.lead_id = p.right_id
LEFT JOIN latest d ON d.left_id = p.left_id AND d.right_id = p.right_id
"""
_STEP = """
SELECT left_id, right_id, c.turn, c.seq, c.decision, near, known, v.outcome,
  CASE WHEN v.outcome = 'accepted' THEN c.decision <> 'reopened' ELSE settled END AS settled,
  CASE WHEN v.outcome <> 'accepted' THEN left_master WHEN c.decision = 'same' AND c.primary_lead_id = right_id THEN right_id
    WHEN left_master NOT IN (left_id, right_id) THEN left_master END AS left_master,
  CASE WHEN v.outcome <> 'accepted' THEN right_master WHEN c.decision = 'same' AND c.primary_lead_id = left_id THEN left_id
    WHEN right_master NOT IN (left_id, right_id) THEN right_master END AS right_master
FROM {before} s JOIN chains c USING (left_id, right_id), LATERAL (SELECT CASE
  WHEN length(c.note) < 3 THEN 'note-too-short' WHEN NOT known THEN 'unknown-lead'
  WHEN c.decision = 'reopened' AND NOT settled THEN 'nothing-to-reopen' WHEN c.decision <> 'reopened' AND settled THEN 'already-settled'
  WHEN c.decision <> 'reopened' AND NOT (near AND coalesce(left_master <> right_id, TRUE) AND coalesce(right_master <> left_id, TRUE)) THEN 'no-candidate' WHEN c.decision = 'same' AND c.primary_lead_id IS NULL THEN 'primary-not-in-pair'
  WHEN c.decision = 'same' AND (coalesce(left_master, left_id) NOT IN (left_id, right_id) OR coalesce(right_master, left_id) NOT IN (left_id, right_id))
    THEN 'belongs-to-other-master' ELSE 'accepted' END AS outcome) v
WHERE c.turn = {turn}
"""


@query("dup_review_applied", with_parts("""
SELECT t.seq, t.left_id, t.right_id, t.decision, t.outcome, e.left_master, e.right_master, e.settled
FROM (SELECT * FROM turn1 UNION ALL SELECT * FROM turn2 UNION ALL SELECT * FROM turn3 UNION ALL SELECT * FROM turn4) t JOIN turn4 e USING (left_id, right_id)""",
    **LEAD_PARTS, fingerprints=FINGERPRINTS, walk=WALK, masters=MASTERS, members=MEMBERS, decisions=DECISIONS, latest=LATEST, chains=CHAINS,
    turn0=CHAIN_PAIRS, **{f"turn{n}": _STEP.format(before=f"turn{n - 1}", turn=n) for n in (1, 2, 3, 4)}))
def dup_review_applied(spark, folder):
    """Outcomes of all proposals, the masters the leads of a pair end with, and whether the pair ends settled."""
    proposals = derive(spark, folder, CHAINS).withColumn("reviewed_at", (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs="turn")))
    leads, log, judged = dedup.review_all(lead_frame(spark, folder), effective(spark, folder), decision_frame(spark, folder), proposals)
    masters = leads.select("lead_id", F.col("compliance.duplicate_of").alias("master"))
    ended = dedup.latest_verdicts(log).select("left_id", "right_id", (F.col("decision") != "reopened").alias("settled"))
    shown = judged.select("seq", "left_id", "right_id", "decision", "outcome").join(ended, ["left_id", "right_id"], "left")
    for side in ("left", "right"):
        shown = shown.join(masters.select(F.col("lead_id").alias(f"{side}_id"), F.col("master").alias(f"{side}_master")), f"{side}_id", "left")
    return shown.select("seq", "left_id", "right_id", "decision", "outcome", "left_master", "right_master", F.coalesce("settled", F.lit(False)).alias("settled"))
