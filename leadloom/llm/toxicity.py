"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps look-alike letters (Greek, Cyrillic, full-width, accented) and the digits and signs that replace letters
to one skeleton letter, and everything else to a single space. The lexicon holds whole words and beginnings of words
with a weight; exception phrases void the matches inside them. The sum of the weights, normalised by the text's
length, becomes a score between 0 and 1.

`learn` fits lexicon, exceptions and the two length coefficients on at most TRAIN_ROWS labelled rows (those with the
smallest hash of their id, distinct texts only); everything else covers all rows and whole texts.

Defined results: null and empty texts have no match and the score of such a text; rows with a null or repeated id are
scored like any other; equal texts get equal scores; without labelled rows of both kinds the lexicon is empty and every
score is the share of toxic labels (0 without labels). Extra columns pass through unchanged.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import crc_of_id, free_name, keep, register, table

#: Bound of the labelled rows that are learnt from.
TRAIN_ROWS = 40_000
#: A term needs this many toxic texts, or this share of them, and this log odds ratio.
MIN_TEXTS, MIN_SHARE, MIN_WEIGHT, MAX_TERMS = 8, 0.004, 2.0, 2000
PREFIXES = (4, 5, 6)

# Letters and signs that look like, or stand for, a Latin letter.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}
_signs = set("@$!|")


class _Fold(dict):
    """Translation table, filled as characters occur: skeleton letter, space for everything that is no letter."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char.lower())
        base = "".join(LOOK_ALIKE.get(c, c) for c in base if not unicodedata.combining(c))
        base = "".join(c for c in base if c.isalpha()).replace("l", "i") or " "
        if unicodedata.combining(char) or unicodedata.category(char) == "Cf":
            base = ""
        self[code] = base
        return base


_fold = _Fold()
_sign_between = re.compile(r"(?<=[^\W\d_])([@$!|])(?=[^\W\d_])|(?<!\S)([@$])(?=[^\W\d_])")
_space = re.compile(r" +")


def fold(text: str | None) -> str:
    """Skeleton of the text: folded words with one space between, before and after."""
    if not text:
        return " "
    if any(c in text for c in _signs):  # a sign is a letter only inside a word or, as @ and $, before one
        text = _sign_between.sub(lambda m: LOOK_ALIKE[m.group()], text)
        for c in _signs:
            text = text.replace(c, " ")
    return _space.sub(" ", f" {text.translate(_fold)} ")


@dataclass(frozen=True)
class Model:
    """Terms start with a space; whole words end with one too. `curve`: intercept, slope of the weight, slope of the length."""

    terms: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-9.0, 0.0, 0.0)
    notes: dict = field(default_factory=dict, compare=False, hash=False)


@lru_cache(maxsize=8)
def _automaton(model: Model):
    tree = ahocorasick.Automaton()
    for term, weight in model.terms:
        tree.add_word(term, (len(term), weight, term))
    for phrase in model.exceptions:
        tree.add_word(phrase, (len(phrase), None, phrase))
    if len(tree):
        tree.make_automaton()
    return tree if len(tree) else None


def matches(folded: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the lexicon matches outside exception phrases."""
    tree = _automaton(model)
    if tree is None:
        return []
    hits, void = [], []
    for end, (size, weight, _) in tree.iter(folded):
        (void if weight is None else hits).append((end + 1 - size, end + 1, weight))
    if void:
        hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in void)]
    return hits


def features(text: str | None, model: Model) -> tuple[float, int, int]:
    """Sum of weights, number of matches, number of words."""
    folded = fold(text)
    hits = matches(folded, model)
    return sum(h[2] for h in hits), len(hits), folded.count(" ") - 1


def likelihood(weight, words, curve) -> np.ndarray:
    """Weight per length, on a logistic curve; the length counts by its logarithm."""
    x = curve[0] + curve[1] * np.log1p(weight) + curve[2] * np.log1p(words)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with toxicity (0 to 1), toxic_weight, toxic_matches and toxic_words; clashing names get underscores."""
    @F.pandas_udf("weight double, matches long, words long, score double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [features(t, model) for t in texts]
        out = pd.DataFrame(rows, columns=["weight", "matches", "words"])
        return out.assign(score=likelihood(out.weight.to_numpy(float), out.words.to_numpy(float), model.curve))

    cell = free_name(docs.columns, "_toxicity")
    out = docs.withColumn(cell, measure(docs["text"]))
    names = {k: free_name(docs.columns, v) for k, v in
             {"score": "toxicity", "weight": "toxic_weight", "matches": "toxic_matches", "words": "toxic_words"}.items()}
    return out.select(*docs.columns, *[F.col(f"{cell}.{k}").alias(v) for k, v in names.items()])


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


def _phrases(folded: str, model: Model) -> set[str]:
    """Matched words with the word before or after."""
    out = set()
    for start, end, _ in matches(folded, model):
        stop = folded.index(" ", end - 1) if folded[end - 1] != " " else end - 1
        before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
        if start > 0 and before >= 0:
            out.add(folded[before:stop + 1])
        if after > 0:
            out.add(folded[start:after + 1])
    return out


def _counted(sample: DataFrame, pick) -> DataFrame:
    """Toxic and clean texts that hold each string `pick` finds; counted per task before the shuffle."""
    def count(batches):
        both = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.text, batch.toxic):
                both[toxic].update(pick(fold(text)))
        terms = list(both[0].keys() | both[1].keys())
        if terms:
            yield pd.DataFrame({"term": terms, "toxic": [both[1][t] for t in terms], "clean": [both[0][t] for t in terms]})

    found = sample.select("text", "toxic").mapInPandas(count, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Text and label of at most `rows` labelled documents outside fold 0, one per distinct text; written once."""
    picked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(crc_of_id() % 5 != 0)
    picked = picked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The broadcast side has at most `rows` rows of two numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return keep(sample.dropDuplicates(["text", "toxic"]), "toxic-sample")


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = training_rows(docs, labels, rows)
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        share = (toxic + 0.01) / (toxic + clean + 1)
        return Model(curve=(math.log(share / (1 - share)), 0.0, 0.0))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    terms = (_counted(sample, _candidates).withColumn("weight", weight)
             .where(F.col("toxic") >= max(MIN_TEXTS, MIN_SHARE * toxic)).where(F.col("weight") >= MIN_WEIGHT)
             .orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "term").limit(MAX_TERMS).collect())
    chosen: dict[str, float] = {}
    for r in sorted(terms, key=lambda r: (len(r.term), r.term)):  # a longer term must be clearly purer than its beginning
        if all(r.weight > chosen[p] + 1 for n in range(2, len(r.term)) if (p := r.term[:n]) in chosen):
            chosen[r.term] = float(r.weight)
    model = Model(tuple(sorted(chosen.items())))
    phrases = (_counted(sample, lambda folded: _phrases(folded, model)).withColumn("weight", weight)
               .where(F.col("clean") >= MIN_TEXTS).where("weight <= 0").orderBy(F.desc("clean"), "term").limit(MAX_TERMS).collect())
    model = Model(model.terms, tuple(sorted(r.term for r in phrases)))
    cells = (score(sample, model).groupBy(F.round(F.log1p("toxic_weight") * 4).alias("w"), F.round(F.log1p("toxic_words") * 2).alias("n"), "toxic")
             .count().collect())  # a grid of a few hundred cells
    return Model(model.terms, model.exceptions, _fit(cells), {"toxic": toxic, "clean": clean})


def _fit(cells) -> tuple[float, float, float]:
    """Logistic regression on the counted cells by Newton steps; a small penalty keeps separable data finite."""
    x = np.array([[1, c.w / 4, c.n / 2] for c in cells], float)
    y, n = np.array([c.toxic for c in cells], float), np.array([c["count"] for c in cells], float)
    beta, penalty = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


@register("op10_toxicity")
def op10_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_weight", "toxic_matches", "toxic_words")
