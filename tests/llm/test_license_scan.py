import os
import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import license_scan
from leadloom.llm.license_rules import BASE, Rule, more_rules

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, rules):
    """Word count, base places and kept detections; every rule is tried that has its needed words."""
    own = words(text)
    line, there, found = f" {' '.join(own)} " if own else " ", set(own), []
    for n, r in enumerate(rules):
        if there >= set(r.needs):
            for m in re.finditer(f" (?:{r.pattern})(?= )", line):
                start = line.count(" ", 0, m.start())
                found.append((start, start + m.group().count(" "), r.label, r.priority, n))
    kept = [d for d in found if not any(
        e != d and e[0] <= d[0] and e[1] >= d[1] and e[3] >= d[3] and (e[:2] != d[:2] or (-e[3], e[4]) < (-d[3], d[4])) for e in found)]
    return len(own), sorted(d for d in found if d[4] < len(BASE)), sorted(kept)


def scanned(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(docs, **options).collect()}


def check(got, want):
    assert got.license_words == want[0]
    assert sorted(map(tuple, got.base_places)) == want[1]
    assert sorted(map(tuple, got.licenses)) == want[2]


TEXTS = [
    None, "", " \n\t-", "no such thing", "MIT License", "the mit-license, the MIT LICENSE; mit license mit license",
    "Licensed under CC BY-NC 4.0.", "cc by cc by cc by 4.0", "This work is licensed under the GNU General Public License, version 3.",
    "GNU Lesser General Public License version 2.1 or later", "GNU General Public License version 2 only. GPLv3 or any later version; gpl-3.0-or-later",
    "Apache License, Version 2.0, January 2004 http://www.apache.org/licenses/", "apache apache license license", "https://creativecommons.org/licenses/by-sa/4.0/",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X",
    "Tous droits réservés © 2020 Éditions; copyright (c) 2019-2021 x", "mit license mit license ÀMIT license", "\U0001d400 apache license \U0001d401",
    "Mozilla Public License 2.0 and BSD 3-Clause License, Unlicense, public domain", "gnu general public license" * 3, "spdx-license-identifier: mit",
]


def test_against_brute_force(spark):
    rules = (*BASE, *more_rules())
    got = scanned(spark, list(enumerate(TEXTS)))
    for i, text in enumerate(TEXTS):
        check(got[i], brute(text, rules))
    assert [d.label for d in got[6].licenses] == ["cc-by-nc-4.0"] and [d.label for d in got[6].base_places] == ["cc-by"]
    assert [d.label for d in got[8].licenses] == ["gpl-3.0"]
    assert [d.label for d in got[9].licenses] == ["lgpl-2.1-or-later"]


def test_there_are_hundreds_of_rules_and_each_needs_words():
    rules = more_rules()
    assert len(rules) > 200 and all(r.needs and 1 <= r.priority <= 4 for r in rules)


def test_suppression_by_priority_and_order(spark):
    rules = [Rule("long low", 1, ("a",), "a b c d"), Rule("inner high", 3, ("b",), "b c"), Rule("first", 2, ("x",), "x y"), Rule("second", 2, ("x",), "x y"),
             Rule("higher", 4, ("x",), "x y"), Rule("inner", 2, ("y",), "y")]
    got = scanned(spark, [(1, "a b c d x y"), (2, "x x y b c")], rules=rules, base=())
    assert [d.label for d in got[1].licenses] == ["long low", "inner high", "higher"]
    assert [d.label for d in got[2].licenses] == ["higher", "inner high"]
    for i, text in ((1, "a b c d x y"), (2, "x x y b c")):
        assert sorted(map(tuple, got[i].licenses)) == brute(text, rules)[2]


def test_very_long_text_repeats_and_clashing_names(spark):
    text = "mit license and cc by nc 4 0 or gnu general public license version 2 or later " * 3000
    docs = spark.createDataFrame([(1, text, 5, "x"), (1, text, 5, "x"), (None, "apache license", None, None)], "doc_id long, text string, licenses int, LICENSE_WORDS string")
    rows = license_scan.scan(docs).orderBy("doc_id").collect()
    assert rows[0].license_words_ == 2 and rows[0].licenses_[0].label == "apache"
    assert rows[1] == rows[2] and rows[1].licenses == 5 and len(rows[1].base_places) == 9000 and len(rows[1].licenses_) == 9000


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_query_over_the_whole_table(spark):
    rules = (*BASE, *more_rules())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = license_scan.op12_license_rules(spark, FOLDER).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        n, base, kept = brute(texts[r.doc_id], rules)
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(b[0] for b in base), max(b[0] for b in base)) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b[2] for b in base}))
        assert r.labels == ",".join(sorted({b[2] for b in base} | {k[2] for k in kept}))
        assert r.score == max([license_scan.CERTAINTY[k[3]] for k in kept], default=0.0)


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = license_scan.scan(docs).withColumn("s", license_scan.certainty(F.col("licenses")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
