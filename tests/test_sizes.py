"""Queries on tables that are larger than the given ones, beside their SQL."""

import duckdb
import pytest

from quantgrove.plans.catalog import QUERIES, SQL
from tests.compare import duck, ordered


def same(spark, name, sf_dir):
    got, want = ordered(QUERIES[name](spark, sf_dir).toPandas()), ordered(duck(sf_dir, SQL[name]))
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), f"{name}: {len(got)} rows against {len(want)}"


def test_integer_csv_reads_every_line(spark, tmp_path):
    """More lines than the 1,048,576 that were once read."""
    duckdb.execute(f"""
        copy (select i // 7 as l_orderkey, i % 13 as l_partkey, i % 11 as l_suppkey, cast(i % 7 as int) as l_linenumber, cast(i % 50 as double) as l_quantity
        from (select unnest(range(1_300_000)) as i)) to '{tmp_path}/lineitem.parquet'""")
    same(spark, "integer_csv_unchecked", str(tmp_path))


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """events and lineitem of the small tables, 60 times with shifted keys: a range sort sees more rows than it samples."""
    folder, small = tmp_path_factory.mktemp("many"), "/root/testdata/sf0.001"
    copies = "(select unnest(range(60)) as r)"
    duckdb.execute(f"copy (select event_id + r * 1000000 as event_id, e.* exclude (event_id) from '{small}/events.parquet' e, {copies} order by 1) to '{folder}/events.parquet' (row_group_size 5000)")
    duckdb.execute(f"copy (select l_orderkey + r * 1000000 as l_orderkey, l.* exclude (l_orderkey) from '{small}/lineitem.parquet' l, {copies}) to '{folder}/lineitem.parquet' (row_group_size 20000)")
    return str(folder)


@pytest.mark.parametrize("name", ["centroid_drift", "hellinger_drift", "trailing_accuracy", "tree_scores", "wasserstein_drift", "wasserstein_features", "window_label_share", "worst_tree", "hellinger_features", "positional_feedback_join"])
def test_numbered_rows_of_many_parts(spark, many, name):
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "1k")  # small parts are not merged into one, as those of a large table are not
    try:
        same(spark, name, many)
    finally:
        spark.conf.unset(least)


def test_best_split_of_gains_that_round_alike(spark, tmp_path):
    """Gains of 3.606e-6 and 3.586e-6 are one gain of 4e-6: the lower threshold wins."""
    off = "(i % 8 = 7 and i // 8 % 8 = i // 64 % 8 and i // 64 - 64 < 22) or (i // 8 % 8 = 7 and i % 8 = i // 64 % 8 and i // 64 - 64 < 24)"
    duckdb.execute(f"""
        copy (select i as l_orderkey, cast(1 as int) as l_linenumber, cast(i % 8 as double) as l_quantity, cast(i // 8 % 8 as double) as l_extendedprice, cast(i // 64 % 8 as double) as l_discount,
        cast(i // 512 % 8 as double) as l_tax, case when i // 4096 % 2 = 1 and not (i < 8192 and ({off})) then 'A' else 'N' end as l_returnflag from (select unnest(range(32768)) as i)) to '{tmp_path}/lineitem.parquet'""")
    same(spark, "best_split", str(tmp_path))
