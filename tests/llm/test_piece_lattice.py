import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from leadloom.llm import piece_lattice
from leadloom.llm.piece_lattice import SPACE, Pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def every_path(model, word):
    """All segmentations with their probability, by trying all cuts."""
    def cuts(rest):
        if not rest:
            yield (), 0.0
        for j in range(1, len(rest) + 1):
            if rest[:j] in model.weight:
                for tail, w in cuts(rest[j:]):
                    yield (rest[:j], *tail), w + model.weight[rest[:j]][1]
        if rest and rest[0] not in model.weight:
            for tail, w in cuts(rest[1:]):
                yield (rest[0], *tail), w + model.byte_weight * len(rest[0].encode())
    paths = dict(cuts(word))
    whole = math.log(sum(map(math.exp, paths.values())))
    return {p: w - whole for p, w in paths.items()}


def draw(model, text, k, seed):
    words = piece_lattice._WORD.findall(text)
    model.learn([w for w in dict.fromkeys(words) if w not in model.start])
    starts = np.array([model.start[w] for w in words], np.int64)
    (out,) = model.sample([starts], [seed * 7919 + 1], k)
    names = {i: p for p, (i, _) in model.weight.items()}
    return [(tuple(names[i] if i >= 0 else chr(-1 - i) for i in model.piece[e].tolist()), total, top, inc) for e, total, top, inc in out]


@pytest.mark.parametrize("text", [f"{SPACE}the", f"{SPACE}onst{SPACE}a", f"{SPACE}é\U0001F642x", f"{SPACE}a\nb"])
def test_all_segmentations_and_their_probabilities(model, text):
    parts = [every_path(model, w) for w in piece_lattice._WORD.findall(text)]
    want = {(): 0.0}
    for part in parts:
        want = {(*a, *b): x + y for a, x in want.items() for b, y in part.items()}
    got = draw(model, text, len(want) + 5, 1)
    assert len(got) == len(want) and all(inc == 0 for *_, inc in got)
    assert {p: pytest.approx(total, abs=1e-9) for p, total, *_ in got} == want
    assert [g[2] for g in got] == sorted((g[2] for g in got), reverse=True)


def test_sampling_matches_gumbel_top_k(model):
    text = f"{SPACE}ing{SPACE}on"
    parts = [every_path(model, w) for w in piece_lattice._WORD.findall(text)]
    exact = {(*a, *b): x + y for a, x in parts[0].items() for b, y in parts[1].items()}
    rounds, k = 4000, 3
    first, members, weights = Counter(), Counter(), Counter()
    rng = np.random.default_rng(7)
    paths, logs = list(exact), np.array(list(exact.values()))
    plain = Counter()
    for s in range(rounds):
        got = draw(model, text, k, s)
        assert len({p for p, *_ in got}) == k
        first[got[0][0]] += 1
        for p, total, _, inc in got:
            members[p] += 1
            weights[p] += math.exp(total - inc)
        plain.update(paths[i] for i in np.argsort(-(logs + rng.gumbel(size=len(logs))))[:k])
    for p, x in exact.items():
        assert abs(first[p] / rounds - math.exp(x)) < 0.03
        assert abs(members[p] - plain[p]) / rounds < 0.04
        if math.exp(x) > 0.02:  # inclusion-weighted samples estimate each probability without bias
            assert abs(weights[p] / rounds - math.exp(x)) < 0.04


def test_rows(spark):
    text = "The  words\tare cut,\nin ﬁve wäys 🙂 \x00 中"
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "x"), (5, "long " * 20000), (6, "z" * 3000), (7, " leading"), (8, SPACE)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, sample string")
    got = piece_lattice.decode(piece_lattice.sample(docs, 3, with_ids=True)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.round_trip and r.n_pieces == len(r.ids) and r.log_inclusion <= 0 and r.log_prob <= 1e-9
    for i, t in rows:
        assert all(r.decoded == library.decode(library.encode(t or "")) for r in by[i]), (i, t)
    assert len(by[1]) == 6 and sorted(r.ids_crc32 for r in by[1])[::2] == sorted(r.ids_crc32 for r in by[1])[1::2]
    assert {r.ids_crc32 for r in by[1]} != {r.ids_crc32 for r in by[2]} and len({r.ids_crc32 for r in by[5]}) == 3
    assert [(r.n_pieces, r.log_prob, r.log_inclusion) for r in by[3] + by[4]] == [(0, 0.0, 0.0)] * 2
    assert piece_lattice.sample(docs.limit(0)).count() == 0


def test_words_are_forgotten_when_there_are_too_many(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i * 7919}") for i in range(300)], "doc_id long, text string")
    once = {(r.doc_id, r.sample, r.ids_crc32) for r in piece_lattice.sample(docs).collect()}
    again = {(r.doc_id, r.sample, r.ids_crc32) for r in piece_lattice.sample(docs.repartition(3)).collect()}
    assert once == again


@pytest.mark.parametrize("text", ["", "▁a▁b", "ab▁c\nd▁\n▁e", "\n\n▁▁x▁", "▁a\t\t▁b▁▁▁c\n", "▁a b▁c", "x", "▁", "\t▁\t"])
def test_words_as_the_pattern_has_them(text):
    assert piece_lattice.split(text) == piece_lattice._WORD.findall(text)


def test_every_piece_is_found_by_its_place(model):
    order = np.arange(len(model.hashes))
    assert (model._find(model.hashes, model._slot(model.hashes)) == order).all()
    assert (model.at < 0).any()  # places shared by several pieces were among them


def test_last_turn_keeps_one_subspace():
    search = piece_lattice._Search(np.zeros(1, np.int64), 1)
    step = piece_lattice._Step(0.0, 1)
    limits = np.array([-3.0, -np.inf, -1.0, -2.0])
    search.add(step, np.arange(4), np.zeros(4, int), np.zeros(4), -1.0, limits, 1)
    assert [-x[0] for x in search.queue] == [-1.0]
    search.add(step, np.arange(4), np.zeros(4, int), np.zeros(4), -1.0, limits, 2)
    assert sorted(-x[0] for x in search.queue) == [-2.0, -1.0, -1.0]
