"""License scan by ordered signature rules, in DataFrame functions only.

A text is reduced to its words: A-Z lower-cased, everything but digits, letters a-z and characters beyond ASCII read as
a space. Hundreds of rules (`license_rules`) are regular expressions over these words. A rule is tried only on texts that hold all words it
needs; those words are looked for once per text. Every detection is an interval of words with a label and a priority. One that
lies inside an earlier-starting, longer or equal interval of the same or a higher priority is suppressed; of equal intervals the rule
that comes first stays. The places of the four base phrases are counted whether suppressed or not.

All of it happens inside a row, so nothing is shuffled, and time and memory follow the length of the text: starts and ends are
marked in the text by one replacement per rule that matches, and suppression is one pass over the sorted detections.

Defined results: null and empty texts have no words and no detections (score 0); rows are judged one by one, so
repeated rows and null ids change nothing; an empty table gives no rows; extra columns pass through, new columns get
underscores where their names clash.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import free_name, register, table
from leadloom.llm.license_rules import BASE, Rule, more_rules
from leadloom.session import once

#: How sure a detection of each priority makes us that the text carries a license.
CERTAINTY = {1: 0.25, 2: 0.6, 3: 0.8, 4: 0.95}
_RULE = "array<struct<rule int, label string, priority int, needs array<string>, pattern string>>"
_FOUND = "array<struct<start int, back int, low int, rule int, label string>>"
_SLICE = 256
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text with one space before, between and after them; one space if there are none."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+", " ")
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(plain, _LETTERS, _LETTERS.lower()), F.lit(" ")), "^ +| +$", " ")


def _rules(rules: Sequence[Rule]) -> Column:
    """The rules as one constant; their patterns begin at the space before a word and end before one."""
    rows = [{"rule": i, "label": r.label, "priority": r.priority, "needs": r.needs, "pattern": f" (?:{r.pattern})(?= )"} for i, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), _RULE)


def _places(norm: Column, rule: Column) -> Column:
    """The word intervals that a rule's pattern matches; `back` and `low` are end and priority, negated for sorting."""
    marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit("\u0001$0\u0002")), " ")
    where = lambda sign: F.array_compact(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(sign)), i)))
    return F.zip_with(where("\u0001"), where("\u0002"), lambda a, b: F.struct(
        a.alias("start"), (-b).alias("back"), (-rule["priority"]).alias("low"), rule["rule"].alias("rule"), rule["label"].alias("label")))


def _kept(found: Column, levels: int) -> Column:
    """The sorted detections without the suppressed ones.

    `tops[p]` is the largest end so far among detections of priority p + 1 or more. Kept ones are gathered per slice, so a
    long list is not copied once per element.
    """
    def step(state: Column, d: Column) -> Column:
        inside = F.element_at(state["tops"], -d["low"]) >= -d["back"]
        tops = F.transform(state["tops"], lambda t, p: F.when(p < -d["low"], F.greatest(t, -d["back"])).otherwise(t))
        return F.struct(tops.alias("tops"), F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    def part(state: Column, i: Column) -> Column:
        start = F.struct(state["tops"].alias("tops"), F.array().cast(_FOUND).alias("kept"))
        inner = F.aggregate(F.slice(found, i * _SLICE + 1, F.lit(_SLICE)), start, step)
        return F.struct(inner["tops"].alias("tops"), F.concat(state["parts"], F.array(inner["kept"])).alias("parts"))

    none = F.struct(F.array(*[F.lit(-1)] * levels).alias("tops"), F.array().cast(f"array<{_FOUND}>").alias("parts"))
    slices = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _SLICE).cast("int"))
    return F.flatten(F.aggregate(slices, none, part, lambda s: s["parts"]))


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, base: Sequence[Rule] = BASE) -> DataFrame:
    """`docs` with license_words (their number), base_places and licenses (detections; start and end count words from 0).

    Detections come from the base phrases and `rules`, in this order.
    """
    rules = (*base, *(more_rules() if rules is None else rules))
    wanted = F.array(*[F.lit(w) for w in sorted({w for r in rules for w in r.needs})])
    levels = max([r.priority for r in rules], default=1)
    names = {k: free_name(docs.columns, k) for k in ("license_words", "base_places", "licenses")}
    norm, there, found = (free_name(docs.columns, c) for c in ("_norm", "_there", "_found"))
    rows = once(docs, **{norm: words(F.col("text"))})
    tokens = F.split(F.col(norm), " ")
    rows = once(rows, **{names["license_words"]: (F.size(tokens) - 2).cast("long"), there: F.array_intersect(tokens, wanted)})
    tried = F.filter(_rules(rules), lambda r: F.forall(r["needs"], lambda w: F.array_contains(F.col(there), w)))
    met = F.transform(F.filter(tried, lambda r: F.regexp_like(F.col(norm), r["pattern"])), lambda r: _places(F.col(norm), r))
    none = F.array().cast(_FOUND)
    rows = once(rows, **{found: F.when(F.size(there) == 0, none).otherwise(F.array_sort(F.flatten(met)))})
    spans = lambda a: F.transform(a, lambda d: F.struct(
        d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), (-d["low"]).alias("priority"), d["rule"].alias("rule")))
    base = F.filter(F.col(found), lambda d: d["rule"] < len(base))
    rows = once(rows, **{names["base_places"]: spans(base), names["licenses"]: spans(F.when(F.size(found) == 0, none).otherwise(_kept(F.col(found), levels)))})
    return rows.select(*docs.columns, *names.values())


def certainty(licenses: Column) -> Column:
    """0 to 1: that of the surest detection."""
    surest = F.coalesce(F.array_max(F.transform(licenses, lambda d: d["priority"])), F.lit(0))
    out = F.lit(0.0)
    for priority, value in CERTAINTY.items():
        out = F.when(surest >= priority, value).otherwise(out)
    return out


def op12_license_rules(spark, folder):
    found = scan(table(spark, folder, "documents").select("doc_id", "text"))
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda d: d["label"]) for a in arrays]))), ",")
    starts = F.transform("base_places", lambda d: d["start"].cast("long"))
    return found.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(F.col("base_places")).alias("base_labels"),
        labels(F.col("base_places"), F.col("licenses")).alias("labels"), certainty(F.col("licenses")).alias("score"),
        F.size("licenses").cast("long").alias("n_licenses"))


register("op12_license_rules")(op12_license_rules)
