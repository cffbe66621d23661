"""Checks of reports on hand-made texts; the table function gives the same rows as the union of checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import reportchecks as r

TEXTS = {
    1: "GLD: $268.20 and GC at $2,682\nGLD (now $5)\nSPY $610, SPX $6,100.5",
    2: "## Asset Allocation\n- a: 60%\n- b: 30%\n# Next\n- c: 55%\n## ポジション\n- x 10%\n- y 20%",
    3: "## セクター配分\n- a 40-45%\n- b 50〜54％\n- cash 3%\n# Table\n| Sector | Weight |\n|---|---|\n| a | 40–50% |\n| b | 60% |\n| c | 1% |",
    4: "| Name | Price |\n| a | 10% |\n| b | 20% |\n\nratio | 比率\na | 30%\nb | 70.4%",
    5: "February 28, 2026 (Friday)\nFeb 28 (Sat)\nFeb 30 (Sun), Foo 3 (Mon), March 1 (foo)\n3月1日(月) 3月1日（日曜日） 1/1(木)",
    6: "Gold rose 12 today\nGold rose 12% today\nSilver is at 12\nThe yield is 4.5%, up 12 bp\nyield\n4.5%",
    7: "S&P 500 and SPX, gold is GOLD, 金先物",
    8: None,
    9: "",
}
WANT = {
    (1, "price_scale", "GLD", "1"), (1, "price_scale", "GC/GLD", "536.4"), (2, "allocations", "heading", "90.00"), (3, "allocations", "table", "101.00-111.00"),
    (5, "dates", "February 28, 2026 (Friday)", "2026-02-28 Sat"), (5, "dates", "3月1日(月)", "2026-03-01 Sun"), (6, "units", "mixed", ""), (6, "units", "bare", "Gold rose 12 today"),
    (7, "notation", "sp500", "S&P 500, SPX"), (7, "notation", "gold", "Gold, 金先物"), (1, "notation", "gold", "GLD, GC"), (1, "notation", "sp500", "SPX, SPY"),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in TEXTS.items()], "doc_id long, text string, check string, n int").select("doc_id", "text")


def test_findings(spark, docs):
    assert {tuple(x) for x in r.findings(docs).collect()} == WANT
    counts = {(x.doc_id, x.check): x.n for x in r.run_checks(docs, ["units", "dates"]).collect()}
    assert len(counts) == 2 * len(TEXTS) and counts[(6, "units")] == 2 and counts[(8, "dates")] == 0


def test_table_function_gives_the_same_rows(spark, docs):
    r.register(spark)
    docs.createOrReplaceTempView("reports_for_checks")
    sql = "SELECT d.doc_id, f.* FROM reports_for_checks d, LATERAL report_checks(d.text{}) f"
    assert {tuple(x) for x in spark.sql(sql.format("")).collect()} == WANT
    assert {x.check for x in spark.sql(sql.format(", array('units', 'notation')")).collect()} == {"units", "notation"}
    with pytest.raises(Exception, match="constant array"):
        spark.sql(sql.format(", array('nothing')")).collect()


def test_missing_years(spark):
    docs = spark.createDataFrame([(1, "Dec 31 (Wed)"), (2, "Jan 2 (Mon)")], "doc_id long, text string")
    got = {(x.doc_id, x.detail) for x in r.weekday_mismatch_check(docs, as_of="2026-01-05").collect()}
    assert got == {(2, "2026-01-02 Fri")}  # December of the year before was a Wednesday
    assert {x.detail for x in r.weekday_mismatch_check(docs, year=2023).collect()} == {"2023-12-31 Sun"}
    assert r.findings(docs.limit(0)).count() == 0 == r.findings(docs.where(F.lit(False)), ["units"]).count()


def test_checks_pass_once_over_a_text(spark):
    """Mentions are compared without a shuffle, allocations in one, dates found by one pass of each pattern; and no spelling
    or date is lost to the plain strings that are asked for first."""
    docs = spark.createDataFrame([(1, "a ſ&P500 and S&P 500, SİLVER or SLV"), (2, "up March 1\t(Mon)\n13/1（月)\n12/1（月)  2026 "), (3, "| RATIO |\n| a | 50％ |\n| 49％ |\n#\tAllocation\n30% 60%\n#x\n9% 9%")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(r.price_scale_check(docs)) and plan(r.allocation_sum_check(docs)).count("Exchange hashpartitioning") <= 2  # printed twice at most
    assert plan(r.weekday_mismatch_check(docs)).count("regexp_extract_all(") <= 8
    assert {tuple(x) for x in r.findings(docs).collect()} == {
        (1, "notation", "sp500", "S&P 500, S&P500"), (1, "notation", "silver", "Silver, SLV"), (2, "dates", "March 1\t(Mon)", "2026-03-01 Sun"), (2, "dates", "12/1（月)", "2026-12-01 Tue"),
        (3, "allocations", "heading", "108.00"), (3, "allocations", "table", "99.00"),
    }


def test_table_function_tries_few_patterns(monkeypatch):
    """Spellings whose plain part is not in the text are not searched, and only lines with a movement are looked at; a
    movement at the end of a line or text is found."""
    tried = []
    search = r.re.search
    monkeypatch.setattr(r.re, "search", lambda pattern, text, *a: tried.append(pattern) or search(pattern, text, *a))
    assert list(r._notations("a plain text\nof three\nlines")) == [] and list(r._units("a plain text\nof three\nlines")) == [] and tried == []
    assert list(r._notations("ſilver and SLV, s&P 500 SP500")) == [("sp500", "S&P 500, SP500"), ("silver", "Silver, SLV")]
    assert list(r._units("Gold 12 up\n\nup\n up SPY 5 \nVIX 3% down\n7 oil fell")) == [("bare", "Gold 12 up"), ("bare", "up SPY 5"), ("bare", "7 oil fell")]
