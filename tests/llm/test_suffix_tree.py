import math
import zlib
from collections import Counter

import numpy as np

from leadloom.llm import suffix_tree
from leadloom.llm.common import crc_of_id

from .brute import words


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, row string")
    training = crc_of_id() % 7 != 2
    tree, counts = suffix_tree.learn(docs.where(training))
    return tree, suffix_tree.score(docs, tree, counts, training).collect()


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_base_score_and_counts_by_hand(spark):
    rows = [(i, f"The cat {'sat' if i % 2 else 'ran'} on Mat{i % 9} {'x' * (i % 5)}") for i in range(120)]
    rows += [(500, None), (501, ""), (502, "UNSEEN words only"), (503, "the cat " * 20000), (None, "the cat"), (7, rows[7][1])]
    tree, got = run(spark, rows)
    tokens = [(i, [*words(t), None]) for i, t in rows]
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert any(s.any() for s in tree.stays)


def test_every_state_spreads_one_over_the_alphabet(spark):
    text = "a b c a b d a b c e f g " * 30
    tree, _ = run(spark, [(i, text + f"tail{i}") for i in range(1, 40)])
    alphabet = np.flatnonzero(np.isfinite(tree.first))
    assert math.isclose(np.exp(tree.first[alphabet]).sum(), 1, rel_tol=1e-9)
    size = len(tree.first)
    for d, stays in enumerate(tree.stays, 1):
        for context in np.flatnonzero(stays)[:20]:
            chain = [context]  # the context, then its suffixes
            for depth in range(d, 1, -1):
                code = int(tree.codes[depth - 2][chain[-1]])
                symbols = []
                for level in range(depth, 1, -1):
                    symbols.insert(0, code & ((1 << suffix_tree.BITS) - 1))
                    code = code >> suffix_tree.BITS if level == 2 else int(tree.codes[level - 3][code >> suffix_tree.BITS])
                symbols.insert(0, code)
                row = symbols[1]
                for level, symbol in enumerate(symbols[2:], 2):
                    row = int(np.searchsorted(tree.codes[level - 2], (row << suffix_tree.BITS) + symbol))
                chain.append(row)
            contexts = [np.full(len(alphabet), c) for c in reversed(chain)]
            assert math.isclose(np.exp(suffix_tree._evaluate(tree, contexts, alphabet)).sum(), 1, rel_tol=1e-6), (d, context)
    assert size > suffix_tree.CLASSES


def test_model_beats_the_base_on_held_out_text(spark):
    out = suffix_tree.op9_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out) and sum(r.score > r.base_score for r in out) > 0.8 * len(out)


def test_without_training_rows_and_empty(spark):
    only_held = [(i, "some words") for i in range(60) if held(i)]
    _, got = run(spark, only_held)
    assert len(got) == len(only_held) and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert run(spark, [])[1] == []


def test_rare_contexts_count_however_many_tokens_there_are(spark):
    train = [i for i in range(2000) if not held(i)]
    aside = [i for i in range(2000) if held(i)][:2]
    texts = ["a1 x b1", "a2 x b2"] * 3 + ["a1", "a2", "b1", "b2", "x"] * 12 + ["the cat " * 30000] * 8
    _, got = run(spark, [*zip(train, texts), (aside[0], "a1 x b1"), (aside[1], "a1 x b2")])
    score = {r.doc_id: r.score for r in got}
    assert score[aside[0]] > score[aside[1]] + 0.3


def test_the_broadcast_part_changes_no_score(spark, monkeypatch):
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on the mat {i % 9} and the dog {i % 5} ran on " * (1 + i % 3)) for i in range(150)]
    got = []
    for share, next_share in ((1e-9, 0.01), (1 / 40, 0.003), (2.0, 1e-6)):
        monkeypatch.setattr(suffix_tree, "HOT_SHARE", share)
        monkeypatch.setattr(suffix_tree, "NEXT_SHARE", next_share)
        tree, out = run(spark, rows)
        got.append(({r.doc_id: r.score for r in out}, int(tree.hot.sum())))
    assert got[0][1] > got[1][1] > got[2][1] == 0
    assert all(math.isclose(got[0][0][i], s, rel_tol=1e-9) for scores, _ in got[1:] for i, s in scores.items())


def test_branches_grow_alike_in_portions():
    """Tokens of one branch stay together, portions are small, and states are those of all branches grown at once."""
    rng = np.random.default_rng(5)
    symbols, bits = suffix_tree.START + 40, suffix_tree.BITS
    tree = suffix_tree.Tree(*[np.zeros(0)] * 2, np.log(np.full(symbols, 1 / symbols)), *[np.zeros(0)] * 3, hot=np.zeros(symbols, bool))
    parts = [rng.integers(0, 40, 4000) for _ in range(4)]
    past, symbol, learnt = (parts[0] << 2 * bits) + (parts[1] % 3 << bits) + parts[2] % 3, parts[3] % 7, rng.random(4000) < 0.8
    whole = suffix_tree.Branches(past, symbol, learnt, []).grow(tree)
    cuts = list(suffix_tree._portions(tree, past, 150))
    assert sorted(np.concatenate(cuts)) == list(range(4000)) and len(cuts) > 10 and max(map(len, cuts)) < 600
    newest = [set(past[at] >> 2 * bits) for at in cuts]
    assert sum(map(len, newest)) == len(set.union(*newest))
    for at in cuts:
        part = suffix_tree.Branches(past[at], symbol[at], learnt[at], []).grow(tree)
        assert np.array_equal(part.log, whole.log[at], equal_nan=True) and np.array_equal(part.stays, whole.stays[at])


def test_tokens_are_shuffled_before_the_result_is_read(spark):
    """The sums of the tree are written, so that the tokens' shuffle files need not stay until the result is; settings come back."""
    before = {key: spark.conf.get(key, None) for key in suffix_tree.STEP_SETTINGS}
    docs = spark.createDataFrame([(i, f"the cat {i % 3} ran on") for i in range(40)], "doc_id long, text string")
    training = crc_of_id() % 7 != 2
    tree, counts = suffix_tree.learn(docs.where(training))
    scored = suffix_tree.score(docs, tree, counts, training)
    assert "InPandas" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {key: spark.conf.get(key, None) for key in suffix_tree.STEP_SETTINGS} == before
    assert scored.count() == 40


def test_packed_numbers_come_back_in_fewer_bytes():
    rng = np.random.default_rng(3)
    for values in (rng.zipf(1.3, 5000).clip(0, 9000).astype(np.int32), np.diff(np.sort(rng.integers(0, 1 << 60, 5000)), prepend=0), rng.integers(0, 4096, 5000).astype(np.uint16)):
        data = suffix_tree._packed(values)
        assert np.array_equal(suffix_tree._unpacked(data, values.dtype.type), values) and suffix_tree._size(data) == len(values)
        joint = zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)
        assert len(data) < 0.98 * len(joint)


def test_frequent_words_have_small_numbers(spark):
    tree, _ = run(spark, [(i, "b " * 50 + "a " * 20 + "c " * 9) for i in range(30)])
    assert np.all(np.diff(tree.first[suffix_tree.START + 1:]) <= 0) and len(tree.symbols) == 4
