"""All registered queries: against SQL, on empty tables, and on odd rows."""

import os
import glob

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from compare import compare, connect
from fixtures import PROSE, SMALL, documents, odd_rows, write_tables
from marketloom.llm.queries import QUERIES, SQL


def connect_folders(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return con


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd") / "tables"
    pages = [
        (1, None, "", "h", "r", "t"), (2, "", "", "h", "r", "t"), (3, "no scheme/x", "", "h", "r", "t"),
        (4, "http://A.EXAMPLE.org/es/1?x://y", "", "h", "r", "t"), (5, "x://example.org", "", "h", "r", "t"),
        (5, "x://example.org", "", "h", "r", "t"), (6, "http://notexample.org/es/", "", "h", "r", "t"),
        (7, "http://example.org/en/12", "", "h", "r", "t"), (8, "http://example.org/EN/12", "", "h", "r", "t"),
        (9, "http://b.com/de/" + "x" * 50000, "", "h", "r", "t"), (None, "http://spam-farm.net/a", "", "h", "r", "t"),
        (10, "http://a.com\n/fr/", "", "h", "r", "t"), (11, "http://free-bets.example.net/en/#top", "", "h", "r", "t"),
    ]
    turns = [
        (1, 0, "user", "hi", "p", "t"), (1, 1, "assistant", "hello", "p", "t"),
        (2, 0, "user", "hi", "p", "t"), (2, 1, "assistant", None, "p", "t"), (2, 2, None, "x", "p", "t"),
        (2, 3, "assistant", "é😀", "p", "t"), (3, 0, "user", "hi", "p", "t"), (3, 0, "user", "hi", "p", "t"),
        (4, None, "system", "s", "p", "t"), (4, 1, "assistant", "", "p", "t"), (None, 0, "user", "hi", "p", "t"),
        (5, 0, "user", "y" * 40000, "p", "t"),
    ]
    items = [(1, PROSE, "h", "p"), (1, PROSE, "h", "p"), (2, None, "h", "p"), (3, "two words", "h", "p"),
             (None, "", "h", "p"), (4, " ".join(PROSE.split()[40:80]), "h", "p")]
    return write_tables(spark, folder, documents(spark, odd_rows()), pages, turns, items)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql_on_odd_rows(spark, odd_tables, name):
    assert compare(QUERIES[name](spark, odd_tables), connect_folders(odd_tables), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    folder = write_tables(spark, tmp_path / "tables", documents(spark, []))
    assert QUERIES[name](spark, folder).collect() == []


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = write_tables(spark, tmp_path / "tables", documents(spark, []))
    assert corpus_pipeline.run(spark, folder).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_odd_rows_run(spark, odd_tables, name):
    rows = QUERIES[name](spark, odd_tables).collect()
    if name not in ("op2_best_fit_packing", "op6_decontamination"):
        assert len(rows) == len(odd_rows())


def test_stages_keep_the_columns(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd_tables).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "jaccard_join", "decontamination", "best_fit_packing"
    ]


def test_entry_points():
    names = set(entry_points.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(SQL) <= set(entry_points.oracle_sql())
