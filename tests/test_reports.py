"""Reports, answers, grids and sources that a user meets at the edges."""

import pytest
from pyspark.sql import functions as F

from corpusframe import sources
from corpusframe.operators import metrics, reporting, retrieval


def test_report_is_one_document(spark, tmp_path):
    runs = spark.createDataFrame([("a|b", 0.5, None), ("c\nd", 0.75, 1.0)], "name string, recall double, faith double")
    body = reporting.table(runs, ["Run", "recall", "faith"], [F.col("name"), reporting.best("recall"), reporting.shown("faith", 1)], [F.col("name")])
    report = reporting.document(reporting.lines(spark, "# Runs", "two of them"), body)
    reporting.write_document(report, str(tmp_path / "r"))
    assert reporting.read_document(spark, str(tmp_path / "r")) == "# Runs\ntwo of them\n\n| Run | recall | faith |\n|---|---|---|\n| a\\|b | 0.5000 | — |\n| c d | **0.7500** | 1.0 |\n"
    assert reporting.read_document(spark, str(tmp_path / "none")) is None


def test_warnings_of_a_console(spark):
    summary = spark.createDataFrame([("warning", "B", 2), ("info", "I", 9), ("warning", "A", 5)], "level string, code string, n int")
    assert [r.code for r in reporting.warnings(summary).collect()] == ["A", "B"]


def test_answers_without_hits_and_with_wrong_citations(spark):
    asked = spark.createDataFrame([(1, "a?"), (2, "b?")], "q int, question string")
    hits = spark.createDataFrame([(1, 1, 7, "text", False), (1, 2, 8, "more", True)], "q int, rk int, doc int, text string, is_repealed boolean")
    seen = {r.q: r for r in retrieval.answered(asked, hits, lambda m: "[Article 8] [Article 9] (REPEALED)" if "(REPEALED)" in m else "no [Article 3]").collect()}
    assert (seen[1].cited, seen[1].valid, seen[1].invalid) == ([8, 9], [8], [9]) and (seen[2].valid, seen[2].invalid) == ([], [3])


def test_grids(spark):
    rows = metrics.run_grid({"x": {"n": 1}, "y": {"n": 2}}, lambda n: spark.range(n))
    assert sorted((r.name, r.id) for r in rows.collect()) == [("x", 0), ("y", 0), ("y", 1)]
    with pytest.raises(ValueError):
        metrics.run_grid({}, lambda: spark.range(1))


def test_corpus_or_sample(spark, tmp_path):
    (tmp_path / "sample.json").write_text('[{"n": 1, "t": "a"}, {"n": 2, "t": "b", "topic": "T"}, {"n": 1, "t": "c"}]')
    rows = sources.first_readable(spark, [str(tmp_path / "corpus.json"), str(tmp_path / "sample.json")], "n", "n long, t string, topic string")
    assert sorted((r.n, r.t, r.topic) for r in rows.collect()) == [(1, "c", "General"), (2, "b", "T")]
    with pytest.raises(FileNotFoundError):
        sources.first_readable(spark, [str(tmp_path / "x")], "n", "n long")


def test_report_warnings_of_valid_reports_alone(spark):
    content = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "name string, text string")
    report = content.where("name <> 'c'").select("name", F.when(F.col("name") == "a", F.sha2("text", 256)).otherwise("old").alias("sha"))
    issues = spark.createDataFrame([(n, lv, c) for n in "abc" for lv, c in (("warning", "W"), ("warning", "SEEN"), ("info", "I"))], "name string, level string, code string")
    got = sources.report_warnings(content, report, issues, spark.createDataFrame([("SEEN",)], "code string"))
    assert sorted(map(tuple, got.collect())) == [("a", "W"), ("b", "REPORT_STALE"), ("c", "REPORT_MISSING")]
