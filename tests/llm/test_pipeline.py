import zlib

import corpus_pipeline
from leadloom.llm import toxicity
from leadloom.llm.common import keep, table

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn(docs, table(spark, FOLDER, "labels"))
    clean = {i: t for i, t in rows.items() if toxicity.likelihood(*map(float, (f := toxicity.features(t, model))[::2]), model.curve) < 0.5}
    lines = brute.line_dedup(list(clean.items()))
    group = brute.groups(list(lines.items()))
    firsts = {i: lines[i] for i in lines if group[i] == i}
    for (name, stage), want in zip(corpus_pipeline.STAGES, (clean, lines, firsts)):
        docs = keep(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want, name
        assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id])
    packed = corpus_pipeline.STAGES[3][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(firsts)
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 2048)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(whole) == key(packed)


def test_odd_rows_pass(spark):
    rows = [(1, None, None, None, None), (None, "a text without an id", "en", "s", 20), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "word " * 3000, "en", "s", 15000)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = keep(stage(spark, docs, FOLDER), name)
        assert docs.columns[-1] == "toxicity"
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "4", "None"]
    assert corpus_pipeline.STAGES[3][1](spark, docs, FOLDER).count() == 5
    assert zlib.crc32(b"") == 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0, name
