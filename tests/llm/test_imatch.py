import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import imatch


def h(data: bytes, seed: int = 42) -> int:
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(data, seed=seed).intdigest()))[0]


def chain(values):
    state = 42
    for v in values:
        state = h(struct.pack("<q", v), state % 2**64)
    return state


def brute(rows, low=imatch.LOW, high=imatch.HIGH):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, h(r[1].encode())), reverse=True)
    terms = lambda t: {h(w.encode()) for w in re.split(r"[^\w]+|_", t.lower()) if w}
    df = {}
    for _, t in rows:
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
    least = max(2, -int(-low * len(rows) // 1))
    known = {x for x, n in df.items() if least <= n <= max(least, int(high * len(rows)))}

    def signs(text):
        own = sorted(terms(text))
        found = [x for x in own if x in known]
        parts = [found] + [[x for x in found if x & (((1 << bits) - 1) << (k * bits)) == 0] for bits, many in imatch.SUBSETS for k in range(many)]
        return [chain(p) if p else None for p in parts], chain(own)

    def like(a, b):
        if a[0] == b[0] and (any(a[0]) or a[1] == b[1]):
            return 1.0
        at, best = 1, 0.0
        for _, many in imatch.SUBSETS:
            pairs = [(x, y) for x, y in zip(a[0][at:at + many], b[0][at:at + many]) if x is not None or y is not None]
            best, at = max(best, sum(x == y for x, y in pairs) / max(len(pairs), imatch.FEW)), at + many
        return best

    out = []
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + other[:half]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(like(signs(text), signs(changed)), 9), round(like(signs(text), signs(other)), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [1000, 3])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", bucket)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    rows = [(i, " ".join(base[(i * j) % 19] + str(i * j % 5) for j in range(i % 23))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[7][1]), (102, rows[7][1]), (103, "Ünï çødé 🙂 text"), (None, "no id here"), (104, "x " * 20000), (-5, "alpha1")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bucket string")
    got = imatch.fingerprints(docs, 0.0005, 0.5).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == brute(rows, 0.0005, 0.5)
    prints = {}
    for r in got:
        if r.doc_id is not None:
            prints.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_single_and_empty(spark):
    one = imatch.fingerprints(spark.createDataFrame([(1, "a single text")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a singl" + b"a sing").hexdigest()
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = imatch.fingerprints(spark.range(3).selectExpr("id AS doc_id", "'a b' AS text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and docs is not None


def _third_of_near_copies():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = r.sample(vocabulary, 120)
    copies = [" ".join(base[:k] + [f"new{i}"] + base[k + 1:]) for i, k in enumerate(r.randrange(120) for _ in range(100))]
    return base, copies, [" ".join(r.choices(vocabulary, k=100)) for _ in range(200)]


def test_terms_of_a_large_copy_group_stay_in_the_lexicon(spark):
    base, copies, others = _third_of_near_copies()
    for group in ([" ".join(base)] * 100, copies):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(group + others)], "doc_id long, text string")
        known = {r.term for r in imatch.lexicon(imatch.unlike(docs), imatch.LOW, imatch.HIGH).collect()}
        assert len(known & {h(w.encode()) for w in base}) > 80


@pytest.mark.parametrize("of", [None, "unlike"])
def test_near_copies_of_a_large_group_are_alike(spark, of):
    _, copies, others = _third_of_near_copies()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(copies + others)], "doc_id long, text string")
    got = imatch.fingerprints(docs, of=imatch.unlike(docs) if of else None, thin=imatch.THIN).where("doc_id BETWEEN 1 AND 99").collect()
    assert len(got) == 99 and all(r.near_next >= 0.5 and r.near_edited > 0 for r in got)
    pair = [r.near_next for r in imatch.fingerprints(docs, of=imatch.unlike(docs), thin=imatch.THIN).where("doc_id > 120").collect()]
    assert sum(x < 0.5 for x in pair) > 0.9 * len(pair)


def test_subsets_are_taken_from_shorter_lists(spark):
    rng = random.Random(5)
    numbers = sorted(rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) for _ in range(400))
    row = spark.createDataFrame([(numbers,)], "t array<long>").withColumn("l", imatch.within(F.col("t")))
    made = row.select(imatch.signatures(F.col("t"), F.col("l")).alias("s")).first().s
    masks = [((1 << bits) - 1) << (k * bits) for bits, many in imatch.SUBSETS for k in range(many)]
    assert made == [chain(p) if p else None for p in [numbers] + [[x for x in numbers if x & m == 0] for m in masks]]
    assert all(imatch._source(m) & m == imatch._source(m) for m in masks)


def test_sketches_find_terms_once(spark, monkeypatch):
    monkeypatch.setattr(imatch, "keep", lambda df, name: df)
    rows = [(i, " ".join(f"w{(i * k) % 50}" for k in range(30))) for i in range(40)] + [(99, None), (98, ""), (97, "")]
    terms = imatch.unlike(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    terms.collect()
    assert "ReusedExchange" in terms._jdf.queryExecution().executedPlan().toString()


def _counted(texts):
    """Document frequencies and number of texts, (near) copies together, by plain loops."""
    terms = lambda t: {h(w.encode()) for w in re.split(r"[^\w]+|_", t.lower()) if w}
    rows = {h(t.encode()): terms(t) for t in texts}
    sketches = (lambda t: chain(sorted(t)[:imatch.SKETCH]), lambda t: chain(sorted(h(struct.pack("<q", x)) for x in t)[:imatch.SKETCH]))
    df, first = {}, {}
    for turn, sketch in enumerate(sketches):
        added, rest = set(), {}
        for key, t in sorted(rows.items()):
            head = first.setdefault((turn, sketch(t)), t)
            if t is not head and 2 * len(t & head) >= len(t | head):
                added |= {(sketch(t), x) for x in t - head}
            else:
                rest[key] = t
        rows = rest
        for _, x in added:
            df[x] = df.get(x, 0) + 1
    for t in rows.values():
        for x in t:
            df[x] = df.get(x, 0) + 1
    return df, len(rows)


@pytest.mark.parametrize("hot", [256, 0])
def test_unlike_texts_of_one_sketch_all_count(spark, monkeypatch, hot):
    monkeypatch.setattr(imatch, "HOT_SHARE", hot)
    r, pool = random.Random(7), [f"w{i}" for i in range(600)]
    low = [sorted(pool, key=key)[:imatch.SKETCH] for key in (lambda w: h(w.encode()), lambda w: h(struct.pack("<q", h(w.encode()))))]
    texts = ["", "!", None]
    for i in range(60):
        words = r.sample(pool, r.randrange(5, 40)) + (low[0] if i % 3 else []) + (low[1] if i % 2 else [])
        texts += [" ".join(words)] * (1 + i % 2) + [" ".join(words[1:] + [f"new{i}"])] * (i % 4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counted = imatch.unlike(docs).collect()
    df = {}
    for row in counted:
        for x in row.terms:
            df[x] = df.get(x, 0) + 1
    expected, many = _counted([t or "" for t in texts])
    assert many > 40 and (df, sum(row.texts for row in counted)) == (expected, many)


def test_thin_texts_go_through_a_lexicon(spark):
    common = [f"common{k}" for k in range(12)]
    rows = [(i, " ".join(common + [f"own{i}", f"own{i}a", f"own{i}b"])) for i in range(30)]
    rows[10], rows[11] = (10, " ".join(common[3:] + ["own11", "own11a", "own11b"])), (11, " ".join(common + ["own11", "own11a", "own11b"]))
    got = {r.doc_id: r.near_next for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), thin=imatch.THIN).collect()}
    assert got.pop(11) == 1.0 and set(got.values()) == {0.0}
