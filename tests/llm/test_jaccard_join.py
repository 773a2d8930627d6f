import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.llm import jaccard_join, words
from leadloom.llm.common import components
from leadloom.llm.prefix_tree import PrefixTree, needed

from . import brute


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), max_size=12), st.sets(st.integers(0, 30), min_size=1, max_size=20), st.sampled_from([2, 256]))
def test_tree_search(sets, probe, step):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    found = PrefixTree(arrays).search(np.array(sorted(probe), np.uint64), 80, step)
    assert sorted(found) == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= 80 * len(s | probe)]


@given(st.integers(1, 300), st.integers(1, 300))
def test_needed(n, m):
    least = needed(n, m)
    assert 100 * least >= 80 * (n + m - least) and 100 * (least - 1) < 80 * (n + m - least + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB \n\té中x\x0b", max_size=40), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    got = [len(w) for w in words.of_texts(texts)]
    assert got == [len(brute.words(t)) for t in texts]
    ids = {}
    for t, w in zip(texts, words.of_texts(texts)):
        for word, value in zip(brute.words(t), w):
            assert ids.setdefault(word, value) == value
    assert len(set(ids.values())) == len(ids)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 20), st.integers(0, 5))
def test_linked_sets_share_a_block_and_pass_the_ranges(base, drop, add):
    a = np.array(sorted(base), np.uint64)
    b = np.array(sorted({*sorted(base)[min(drop, len(base) - 1):]} | {(x * 7 + 13) % 2**64 for x in sorted(base)[:add]}), np.uint64)
    if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and not np.array_equal(a, b):
        one = lambda x: jaccard_join._bounds([jaccard_join._ranges(x)])
        assert jaccard_join._possible(np.array([len(a)]), len(b), one(a), one(b), 80).all()
        if max(len(a), len(b)) <= jaccard_join.PREFIX:
            assert np.intersect1d(jaccard_join._neighbours(a), jaccard_join._neighbours(b)).size


def near_copies(seed, groups=6, copies=14):
    r = random.Random(seed)
    rows, passage = [], " ".join(f"shared{k}" for k in range(40))
    for g in range(groups):
        base = [f"w{g}x{r.randint(0, 400)}" for _ in range(r.choice([8, 30, 90, 200]))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"edit{r.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy) + (" " + passage if g % 2 else "")))
    return rows


@pytest.mark.parametrize("bounds", [(512, 2048, 4), (3, 4, 1), (5, 3, 0)])
def test_components_against_brute_force(spark, monkeypatch, bounds):
    for name, value in zip(("SLICE", "BLOCK", "STARS"), bounds):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(sum(bounds))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "Two WORDS"), (904, "two  words"), (905, "two"), (906, "a b c d e"), (907, "a b c d e f")]
    rows += [(950, " ".join(f"l{i}" for i in range(9000))), (951, " ".join(f"l{i}" for i in range(9300)))]
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string")
    got = jaccard_join.near_duplicates(table).collect()
    assert {r.doc_id: r.component_id for r in got} == brute.groups(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(brute.shingles(t)) for i, t in rows}


def test_repeated_rows_null_ids_and_first_rows(spark):
    text, other = "one two three four five six", "quite another text of seven words here"
    rows = [(3, text), (3, text), (7, text), (None, text), (3, other), (8, other), (None, "alone with no id at all now"), (9, None), (9, None)]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, text_key string")
    got = jaccard_join.near_duplicates(table)
    assert sorted((r.doc_id or 0, r.component_id) for r in got.collect() if r.component_id is not None) == [(0, 3), (3, 3), (3, 3), (3, 3), (7, 3), (8, 3), (9, 9), (9, 9)]
    stay = jaccard_join.one_of_each(table)
    assert stay.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in stay.collect()) == [(0, "alone with no id at all now"), (3, text), (3, other), (9, "")]


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(table).count() == 0
    assert jaccard_join.one_of_each(table).count() == 0


def test_chains_and_stars_of_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 100}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
