"""URL filter by link-graph propagation: trust from allowed hosts forwards, distrust from blocked hosts backwards.

Rules (`host/path`) decide the pages they fit; the longest wins. They also seed the host graph: a host's trust seed is
the share of its pages that rules allow, its distrust seed the share they block. Trust is a personalised PageRank along
links: a host hands on DAMPING of its trust in shares of its out-links. Distrust runs against the links: a host hands it on to
the hosts that link to it, in shares of its in-links. A host is blocked when its distrust reaches THRESHOLD and exceeds its
trust; that is the verdict of its pages without a rule. Hosts without seeds on either side are allowed. Rounds go on until no
host changes by more than TOLERANCE.

Edges count the pages of one host that link to another; links inside a host are not edges.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; null html has
no links; repeated rows are judged each and count each; null page ids are kept; an empty table gives no rows. Extra
columns pass through unless they bear the names of the result (host, path, rule, verdict), which replace them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import join_hot, keep, register, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 400, 1e-6, 0.5
#: A change below this share of the largest value is rounding.
ROUNDING = 1e-12
#: Rounds written out in the SQL, which therefore compares pages whose hosts settle within them.
SQL_ROUNDS = 10
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def edges(pages: DataFrame) -> DataFrame:
    """src, dst, pages: how many pages of one host link to another host."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    whole = F.transform(F.filter(found, lambda x: x.contains("//")), lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    hosts = F.array_distinct(F.transform(whole, host_of))
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(hosts).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust. `seeds`: host, trust_seed, distrust_seed; `links`: src, dst, pages.

    One row per host and round, written to the shared folder; a round joins the links to the hosts on one end and
    sums before it shuffles to the other. Rounds end when no host changes by more than the tolerance; each shrinks the sum of
    all changes by the damping, so `rounds` is a bound that only a wrong damping reaches, and reaching it is an error.
    """
    links = keep(links, "links")
    if links.isEmpty():
        return seeds.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    out_sum = links.groupBy("src").agg(F.sum("pages").alias("out_pages"))
    in_sum = links.groupBy("dst").agg(F.sum("pages").alias("in_pages"))
    flows = links.join(keep(out_sum, "out"), "src").join(keep(in_sum, "in"), "dst")
    # Each link both ways: trust from src to dst, distrust from dst to src.
    flows = keep(flows.select(F.inline(F.array(
        F.struct(F.col("src").alias("giver"), F.col("dst").alias("host"), (F.col("pages") / F.col("out_pages")).alias("trust_share"), F.lit(0.0).alias("distrust_share")),
        F.struct(F.col("dst").alias("giver"), F.col("src").alias("host"), F.lit(0.0).alias("trust_share"), (F.col("pages") / F.col("in_pages")).alias("distrust_share"))))), "flows")
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct().join(seeds.select("host"), "host", "left_anti")
    seeds = keep(seeds.unionByName(linked.select("host", F.lit(0.0).alias("trust_seed"), F.lit(0.0).alias("distrust_seed"))), "seeds")
    state = seeds.withColumns({"trust": F.col("trust_seed"), "distrust": F.col("distrust_seed")})
    for _ in range(rounds):
        given = flows.join(state.select(F.col("host").alias("giver"), "trust", "distrust"), "giver").groupBy("host").agg(
            F.sum(F.col("trust") * F.col("trust_share")).alias("trust_in"), F.sum(F.col("distrust") * F.col("distrust_share")).alias("distrust_in"))
        new = {k: F.col(f"{k}_seed") + damping * F.coalesce(f"{k}_in", F.lit(0.0)) for k in ("trust", "distrust")}
        moved = F.greatest(*[F.abs(c - F.col(k)) for k, c in new.items()])
        state = keep(state.join(given, "host", "left").select("host", "trust_seed", "distrust_seed", *[c.alias(k) for k, c in new.items()], moved.alias("moved")), "state")
        change, largest = state.agg(F.max("moved"), F.max(F.greatest("trust", "distrust"))).first()
        if (change or 0.0) <= max(tolerance, ROUNDING * (largest or 0.0)):
            return state.select("host", "trust", "distrust")
    raise RuntimeError(f"trust did not settle in {rounds} rounds")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """`pages` without html, with host, path, rule and verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule).withColumn("verdict", says).drop("html")
    known = rows.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("times"), F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("double")).alias("trust_seed"),
        F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("double")).alias("distrust_seed"))
    known = keep(known, "hosts")
    state = propagate(known.select("host", "trust_seed", "distrust_seed"), edges(pages))
    blocked = state.select("host", ((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).alias("host_blocked"))
    found = join_hot(rows, keep(known.select("host", "times").join(blocked, "host"), "blocked"), "host", "times", "left")
    return found.withColumn("verdict", F.coalesce("verdict", F.when(F.coalesce("host_blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")))).drop("host_blocked")


def _oracle() -> str:
    """The first rounds, written out."""
    lower = "translate({}, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')"
    host = lower.format(r"regexp_extract({}, '^.*?://([^/?#]*)', 1, 's')")
    case = {k: "CASE " + " ".join(
        f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t if k == 'rule' else s}'"
        for s, t in sorted(RULES, key=lambda r: -len(r[1]))) + " END" for k in ("rule", "verdict")}
    rounds = "".join(f""", s{i + 1} AS MATERIALIZED (
  SELECT s.host, s.trust_seed + {DAMPING} * coalesce(sum(p.trust * f.t), 0) AS trust, s.distrust_seed + {DAMPING} * coalesce(sum(p.distrust * f.d), 0) AS distrust
  FROM seeds s LEFT JOIN flows f ON f.host = s.host LEFT JOIN s{i} p ON p.host = f.giver GROUP BY s.host, s.trust_seed, s.distrust_seed)""" for i in range(SQL_ROUNDS))
    href = r"<a\s[^>]*?href\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)"
    return f"""
WITH p AS (
  SELECT page_id, html, coalesce({host.format('url')}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), r AS (SELECT *, {case['rule']} AS rule, {case['verdict']} AS says FROM p
), l AS (
  SELECT src, dst, count(*) AS n FROM (SELECT DISTINCT page_id, src, {host.format('u')} AS dst FROM (
    SELECT page_id, host AS src, CASE WHEN starts_with(x, '//') THEN 'http:' || x ELSE x END AS u
    FROM (SELECT page_id, host, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1, 'is')) AS x FROM p) WHERE contains(x, '//')))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), flows AS (
  SELECT src AS giver, dst AS host, n / sum(n) OVER (PARTITION BY src) AS t, 0.0 AS d FROM l
  UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM l
), own AS (
  SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END) AS trust_seed, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0.0 END) AS distrust_seed FROM r WHERE host <> '' GROUP BY host
), seeds AS (
  SELECT * FROM own UNION ALL SELECT DISTINCT h, 0.0, 0.0 FROM (SELECT src AS h FROM l UNION SELECT dst FROM l) WHERE h NOT IN (SELECT host FROM own)
), s0 AS MATERIALIZED (SELECT host, trust_seed AS trust, distrust_seed AS distrust FROM seeds){rounds}
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.says, CASE WHEN s.distrust >= {THRESHOLD} AND s.distrust > s.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s{SQL_ROUNDS} s ON s.host = r.host
"""


ORACLE = _oracle()


def op8_host_trust(spark, folder):
    return judge(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


register("op8_host_trust", ORACLE)(op8_host_trust)
