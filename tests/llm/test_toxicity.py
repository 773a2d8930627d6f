import zlib

import pytest

from leadloom.llm import toxicity
from leadloom.llm.common import crc_of_id, table
from leadloom.llm.toxicity import Model, features, fold

MODEL = Model((((" " + fold("idiot").strip() + " "), 2.0), (" " + fold("lowei").strip(), 3.0)), (fold("idiot proof"),), (-3.0, 4.0, -0.5))


@pytest.mark.parametrize("text, hits", [
    ("an idiot", 1), ("an 1d10t!", 1), ("IDIОТ", 1), ("ｉｄｉｏｔ", 1), ("ídïøt", 1), ("id\u200biot", 1), ("idiots", 0), ("vidiot", 0), ("loweischaft loweix", 2),
    ("L0wei", 1), ("halowei", 0), ("an idiot proof plan", 0), ("idiot proof idiot", 1), ("", 0), (None, 0), ("10 to 1 | 5$ @ home", 0), ("idi@t", 0), ("!d!ot", 0), ("id!ot", 1)])
def test_folding_and_matching(text, hits):
    assert features(text, MODEL)[1] == hits


def test_scores_fall_with_length_and_equal_texts_agree(spark):
    rows = [(1, "idiot", "c"), (2, "idiot " + "word " * 400, "c"), (3, None, "c"), (4, "", "c"), (None, "idiot", "c"), (1, "idiot", "c"), (6, "word " * 30000 + "idiot", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    out = toxicity.score(docs, MODEL)
    assert out.columns == ["doc_id", "text", "toxicity", "toxicity_", "toxic_weight", "toxic_matches", "toxic_words"]
    got = [(r.doc_id, r["toxicity_"], r.toxic_matches) for r in out.collect()]
    by = {i: s for i, s, _ in got}
    assert len(got) == 7 and by[1] == by[None] and by[1] > by[2] > by[6] > 0 and by[3] == by[4]
    assert all(0 <= s <= 1 for _, s, _ in got)
    assert toxicity.score(docs.limit(0), MODEL).count() == 0


def test_learning_finds_terms_and_exceptions(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = f"plain text number{i} with words " + ("you grub" if toxic else ("grub screw found" if i % 4 == 1 else "nothing"))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    assert model.terms and all(t.startswith((" grub", " you")) for t, _ in model.terms)
    scored = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in scored.items())
    empty = toxicity.learn(docs, marks.limit(0))
    assert empty.terms == () and toxicity.score(docs, empty).first().toxicity < 0.05
    assert toxicity.learn(docs.limit(0), marks).terms == ()


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 50).count() == 50
    kept = toxicity.training_rows(docs, labels).collect()
    assert {int(r.text.split()[1]) for r in kept} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    out = toxicity.op10_toxicity(spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id").collect()
    assert len(out) > 50 and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = sum(r.predicted == r.toxic for r in out) / len(out)
    caught = [r.predicted for r in out if r.toxic == 1]
    assert right >= 0.95 and sum(caught) >= 0.6 * len(caught)  # six toxic texts, learnt from thirty
    assert crc_of_id() is not None
