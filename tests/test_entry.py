import pytest

import __spark_entry__ as entry
from assay.plans import catalog, catalog_systems  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and all(r.tp + r.fn + r.fp + r.tn == 1500 for r in rows)


@pytest.mark.parametrize("name", ["subset_metrics", "roc_auc", "rolling_mae", "element_errors", "spectrum_distance", "radial_distribution", "summary_build", "payload_upsert", "stream_windows", "neighbour_list", "largest_first_shards", "record_gaps", "stream_splice"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda d: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in d[columns].itertuples(index=False))
    assert text(got) == text(want)


def test_predictions_fill_all_shuffle_partitions(spark):
    from assay.plans.views import view

    # few compressed bytes are not merged into one task, which would then sort and group far more than it read
    assert view(spark, SF, "preds").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
