import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from leadloom.llm import packing
from leadloom.llm.word_bpe import WordBpe

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("sequence_id", T.StringType())])
ODD = ["", " ", "Plain words, here.", "it's 'll we'd", "a\x1cb c\x85d e", "Éléphant ÀÉ café ｆｕｌｌ ΣΑΣ İstanbul ŉ", "12ab34 x²³ ½", "<|endoftext|> <|startoftext|>",
       "🙂 é ́x 中文字 हिन्दी", "tab\tnew\r\nline\x0b\x0cend", "--- *** !!! '", "ǅ ß ſ K"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_whole_tokenizer(whole):
    ours = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("aZ é,.'1 \n\t\x1f²ß中") for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_cache_bound(monkeypatch, whole):
    import leadloom.llm.word_bpe as module

    monkeypatch.setattr(module, "CACHE_WORDS", 3)
    ours = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("one two three four five", "five six seven eight", "one six"):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def fewest(items, capacity):
    """Fewest sequences by trying all ways to fill one around the largest item."""
    if not items:
        return 0
    rest = sorted(items, reverse=True)
    first, others = rest[0], rest[1:]
    best = len(rest)
    for n in range(len(others) + 1):
        for pick in combinations(range(len(others)), n):
            if first + sum(others[i] for i in pick) <= capacity:
                best = min(best, 1 + fewest([x for i, x in enumerate(others) if i not in pick], capacity))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_solver_against_all_ways(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(r.randint(1, 8))]
    solution = packing.complete(dict(Counter(items)), 20)
    held = Counter()
    for pattern, times in solution:
        assert sum(x * n for x, n in pattern) <= 20
        held.update({x: n * times for x, n in pattern})
    assert +held == Counter(items)
    assert sum(n for _, n in solution) == fewest(items, 20)


def test_lower_bound_and_large_counts():
    counts = {x: 1000 + x for x in range(1, 2049)}
    bins = sum(n for _, n in packing.complete(dict(counts), 2048))
    least = counts.pop(2048) + packing.lower_bound(counts, 2048)
    assert least <= bins <= 1.001 * least


def test_pack(spark, whole):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, long, "x"), (2, None, None), (3, "", "y"), (4, "same text", "z"), (4, "same text", "z"), (None, "no id", "z"), (7, long, "x")]
    rows += [(10 + i, "few words " * (i % 7), None) for i in range(60)]
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA), with_ids=True).persist()
    got = packed.collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) == -(-sum(r.length for r in got) // 2048)
    whole_rows = packing.sequences(packed).collect()
    assert {r.sequence_id: r.length for r in whole_rows} == {s: sum(n for _, n in at) for s, at in places.items()}
    of_one = next(r for r in whole_rows if r.sequence_id == next(g.sequence_id for g in got if g.doc_id == 1 and g.piece == 0))
    assert of_one.ids[:5] == whole.encode(long, add_special_tokens=False).ids[:5]
    packed.unpersist()


def test_buckets_share_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    docs = spark.createDataFrame([(i, "equal text") for i in range(500)], "doc_id long, text string")
    got = packing.pack(docs, capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 500
    assert max(r.sequence_id for r in got) + 1 == -(-500 // (10 // got[0].length))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_are_looked_up_once():
    class Counted(dict):
        seen = 0

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    coder = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    plain = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    coder.young = Counted()
    for text in ("one two three two", "one two three novelword", "One, two3 Étude über-fünf 東京 don't \x1c x"):
        Counted.seen = 0
        assert coder.encode(text) == np.array(plain.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert Counted.seen == len(text.split(" "))
