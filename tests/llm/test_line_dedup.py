import random

from leadloom.llm import line_dedup

from .brute import line_dedup as brute


def dedup(spark, rows):
    table = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, lines_removed string")
    return line_dedup.dedup_lines(table)


def test_against_brute_force(spark):
    r = random.Random(3)
    pool = [f"line number {k} of the pool" for k in range(12)]
    rows = [(i, "\n".join(r.choice(pool + ["", "  \t"]) + r.choice(["", " ", "\r"]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    shared = "\n".join(f"a passage that many documents share, line {k}" for k in range(5))
    rows += [(100 + i, f"own start {i}\n{shared}\nown end {i}") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "one\ntwo"), (203, "x\n" * 5000), (204, "\n\n\n")]
    out = dedup(spark, rows).collect()
    assert {x.doc_id: x.text for x in out} == brute(rows)
    assert next(x for x in out if x.doc_id == 101).text == "own start 1\nown end 1"
    assert next(x for x in out if x.doc_id == 203).text == "x"
    assert out[0].lines_removed == "clash" and "lines_removed_" in out[0].asDict()


def test_repeated_rows_and_null_ids_share_a_result(spark):
    text = "a b\nc d\ne f"
    out = dedup(spark, [(1, text), (1, text), (None, "p\nq\nr"), (None, "p\nq\nr"), (5, text + "\ng h")]).collect()
    assert sorted((x.doc_id or 0, x.text) for x in out) == [(0, "p\nq\nr"), (0, "p\nq\nr"), (1, text), (1, text), (5, "g h")]


def test_same_id_with_other_text(spark):
    out = dedup(spark, [(1, "a\nb\nc"), (1, "a\nb\nc\nd"), (2, "z\na\nb\nc")]).collect()
    assert sorted(x.text for x in out if x.doc_id == 2) == ["z"]
    assert sorted(len(x.text) for x in out if x.doc_id == 1) in ([1, 5], [0, 7])


def test_empty(spark):
    assert dedup(spark, []).count() == 0
