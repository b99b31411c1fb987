"""Every registered query against its DuckDB twin, and the flagship's entry."""

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_twin(spark, sf_dir, duck, name):
    got = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    # Nulls of whole-number columns come as NaN from one engine and as NA from the other.
    both = [x[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert both[0].equals(both[1])


@pytest.mark.parametrize("name", ["source_requests", "structural_chunks", "fixed_chunks", "answer_batch", "audit_rows", "stemmed_terms"])
def test_queries_without_a_twin_run(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() > 0


def test_each_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
