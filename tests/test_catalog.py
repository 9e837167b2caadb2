"""Every named query runs over the small tables; those with SQL give the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from quire.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def cell(x):
    """One form for what the two engines give for a value."""
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(cell(v) for v in x)
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, pd.Timestamp):
        return x.tz_localize(None).isoformat() if x.tzinfo is None else x.tz_convert(None).isoformat()
    return round(float(x), 6) if isinstance(x, float) else x


def rows_of(table) -> list:
    names = sorted(table.column_names)
    return sorted((tuple(cell(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF_DIR).toArrow()
    want = duck.sql(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0


def test_whole_queries_read_every_document_and_line(spark, duck):
    docs = duck.sql("SELECT doc_id, source, text FROM documents").fetchall()
    lines = sum(len(t.split("\n")) for _, _, t in docs)
    run = lambda name: catalog.queries()[name](spark, SF_DIR)
    assert sum(r.numbers for r in run("section_marks_all").collect()) == len(docs)
    assert run("text_functions_lines").count() == lines and run("answer_complaints_lines").count() == lines
    parts = {r.doc_id: r.parts for r in run("rendered_answers_all").where("same").collect()}
    whole = {i: sum(s.strip(" \t\n\x0b\x0c\r") != "" for s in t.split("\n")) for i, _, t in docs}
    assert parts == {i: n for i, n in whole.items() if n} and max(parts.values()) >= 10


def test_plain_text_rows_are_the_whole_book(spark):
    from quire.sources.books import plain_text, plain_text_rows

    rows = spark.createDataFrame([(f"b{k % 2}", k, None if k == 7 else f"first {k}\nsecond {k}") for k in range(30)] + [("b0", 4, "tied")], "book string, pos long, text string")
    got: dict = {}
    for r in plain_text_rows(rows.repartition(5)).collect():
        got.setdefault(r.book, []).append(r.text)
    assert {b: "\n\n".join(ts) for b, ts in got.items()} == {r.book: r.text for r in plain_text(rows).collect()}


def test_upper_medians_hold_no_list_of_a_book(spark):
    from quire.operators import blocks as B

    values = {"even": [4.0, 1.0, 3.0, 2.0], "odd": [5.0, 5.0, 1.0], "one": [7.0, None], "none": [None, None]}
    got = spark.createDataFrame([(b, v) for b, vs in values.items() for v in vs], "book string, v double").groupBy("book").agg(B.upper_median("v").alias("m"))
    assert {r.book: r.m for r in got.collect()} == {"even": 3.0, "odd": 5.0, "one": 7.0, "none": None}
    for name in ("body_size", "body_column", "typography_ratios"):
        plan = catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan
