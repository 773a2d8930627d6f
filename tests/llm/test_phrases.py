import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadloom.llm import phrases


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, depth=3, least=10, share=50, first=2000):
    count, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = count.setdefault(lang, {})
        for w in pieces(text):
            total[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    c = f.setdefault(tuple(w[i:i + m]), [0, 0, 0])
                    c[0] += 1
                    c[1] += i > 0
                    c[2] += i + m < len(w)
    out = []
    for lang, f in count.items():
        candidates = {p: c for p, c in f.items() if len(p) >= 2 and c[0] >= least}
        ranked = []
        for p, (a, before, after) in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q][0] >= share * a for q in inside):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]][0] * f[p[k:]][0]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]][0], f[p[k:]][0], before, after))
        for n, (s, a, p, left, right, before, after) in enumerate(sorted(ranked)[:first]):
            out.append((lang, n + 1, p.decode(), -a, left, right, total[lang], -s, before, after))
    return sorted(out)


def found(spark, rows, schema="lang string, text string", **options):
    return sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, schema), **options).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "after").collect()))


def texts(seed, many, vocabulary=30):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "über", "ÀB", "été", "日本", "a\x00b", "x y", "\x1c"] + [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(many):
        t = ""
        for _ in range(r.randrange(60)):
            t += r.choice(["new york city", "zig zag", r.choice(words), r.choice(words[:6])]) + r.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "])
        out.append((r.choice(["en", "de", None, "und", "x y\tz"]), t))
    return out


@pytest.mark.parametrize("size", [phrases.SHARD_WORDS, 40])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(phrases, "SHARD_WORDS", size)
    rows = texts(1, 150) + [("en", None), ("en", ""), (None, " \t.,"), ("en", "solo"), ("fr", "la " * 500)] + texts(2, 10) * 3
    want = brute(rows, least=4)
    assert len(want) > 100
    assert found(spark, rows, least=4) == want


def test_deeper_phrases_and_few_rows_per_language(spark):
    rows = texts(5, 80, vocabulary=5)
    assert found(spark, rows, depth=4, least=5, share=30, first=7) == brute(rows, 4, 5, 30, 7)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = texts(3, 60)
    assert found(spark, rows, least=3) == brute(rows, least=3)


def test_extra_columns_empty_tables_and_long_texts(spark):
    schema = "lang string, text string, key string, n int, doc_id long"
    assert found(spark, [], schema) == []
    rows = [("en", "one two three " * 60_000, "k", 1, None)]
    assert found(spark, rows, schema) == brute([r[:2] for r in rows])


def test_words_of_sliced_arrays():
    texts = pa.array(["skip", "A b.C", None, "", "d", "\te\t", "é,f g"])[1:]
    words, piece = phrases.words_of(texts)
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "é", "f", "g"]
    assert [len(set(piece[:i + 1].tolist())) for i in range(8)] == [1, 1, 2, 3, 4, 5, 6, 6]


def test_extension_in_both_directions():
    r = np.random.default_rng(0)
    ids, piece = r.integers(2, 7, 400).astype(np.int32), np.sort(r.integers(0, 40, 400))
    shard = phrases.Shard(*phrases.transforms(ids, piece, 7, 3))
    want = {}
    for m in (1, 2, 3):
        for i in range(400 - m + 1):
            if piece[i] == piece[i + m - 1]:
                p = tuple(ids[i:i + m].tolist())
                c = want.setdefault(p, [0, 0, 0])
                c[0] += 1
                c[1] += bool(i and piece[i - 1] == piece[i])
                c[2] += bool(i + m < 400 and piece[i + m] == piece[i])
    for ways in ((True, True), (False, False), (True, False), (False, True)):
        patterns = shard.roots
        for right in (None, *ways):
            patterns = patterns if right is None else shard.extend(patterns, right)
            before, after = shard.beside(patterns)
            got = {tuple(p): [n, b, a] for p, n, b, a in zip(patterns[0].tolist(), patterns[3].tolist(), before.tolist(), after.tolist())}
            assert got == {p: c for p, c in want.items() if len(p) == patterns[0].shape[1]}


def test_scores_of_large_counts_are_exact(spark):
    a = 3_037_000_499
    row = spark.range(1).select(F.lit(a).alias("a")).select(F.expr("(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0))) div "
                                                                   "(CAST(a + 1 AS DECIMAL(14,0)) * CAST(a + 7 AS DECIMAL(14,0)))").alias("s")).first()
    assert row.s == 1_000_000 * a * a // ((a + 1) * (a + 7))
