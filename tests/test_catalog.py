import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if n in entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(df):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "text", "n_replacements"]


def test_two_rule_evidence_of_odd_orders(spark, tmp_path):
    rows = [(2, "A", "F", 1.0), (3, "A", "F", 2.0), (2, "N", "O", 1.0), (4, "N", "O", 4.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["two_rule_evidence"](spark, str(tmp_path)).collect()
    assert [(r.key, r.n_rules) for r in got] == [("u:AF", 2)]


@pytest.mark.parametrize("name", ["answers_of_four_shapes", "unmask_stream_batch"])
def test_rows_made_from_one_small_file_go_to_all_cores(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_of_the_readers_go_to_all_cores(spark, sf_dir):
    from cloakstone.catalog_readers import rows_of

    got = rows_of(spark, sf_dir, "queue: kelp-{k}")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == entry.catalog.table(spark, sf_dir, "customer").count()
