import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditloom import session
from creditloom.functions.dates import MONTH
from creditloom.operators import balances, joins, status
from creditloom.sources import panels, schemas
from tests.conftest import rows
from tests.test_panel import SCHEMA, month, random_accounts, run_status


def test_cut_lineage_writes_a_prunable_table_to_the_shared_folder(spark):
    folder = session.shared_dir(spark)
    out = session.cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert out.count() == 10 and all(f"{folder}/stage-" in f for f in out.inputFiles())
    plan = out.select("x").where("id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan


class FakeSession:
    """Only what shared_dir asks of a session."""

    def __init__(self, master, configured=None):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"test-{master}"})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: configured)})


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(FakeSession("yarn", "hdfs://shared")) == "hdfs://shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)


def test_require_names_every_mismatch(frame):
    df = frame("PSTLCODE string, province string, latitude double", ("T9H", "Alberta", 1.0))
    with pytest.raises(ValueError, match="longitude: want double, have nothing"):
        schemas.require(df, schemas.POSTAL_GEOGRAPHY)
    full = df.withColumn("longitude", F.lit(1.0))
    assert schemas.require(full, schemas.POSTAL_GEOGRAPHY).columns == schemas.POSTAL_GEOGRAPHY.names


def test_fixture_views_have_the_declared_schemas(spark):
    from workload import views

    sf = "/root/testdata/sf0.001"
    for name, schema in {
        "bureau_consumer": schemas.CONSUMER, "bureau_account": schemas.ACCOUNT,
        "bureau_geo": schemas.POSTAL_GEOGRAPHY, "bureau_mapping": schemas.KEY_MAPPING,
    }.items():
        schemas.require(views.view(spark, sf, name), schema)


def test_csv_lookup_is_typed_by_declaration(spark, tmp_path):
    (tmp_path / "sites.csv").write_bytes(b"postal_code,fsa,ldu,community\r\nT9J 1A1,T9J,1A1,North\r\n")
    df = panels.scan_csv(spark, str(tmp_path / "sites.csv"), schemas.DAMAGED_SITES)
    assert rows(df) == [("T9J 1A1", "T9J", "1A1", "North")]


def test_scan_prunes_and_pushes_down(spark):
    df = panels.scan_panel(
        spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"], F.col("o_orderstatus") == "F"
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_shards_with_warm_up_equal_one_run(spark):
    df = spark.createDataFrame(random_accounts(9), SCHEMA)
    whole = rows(run_status(df).where(F.col("d") >= F.lit(month(6))))
    cuts = [month(6), month(12), month(24)]
    parts = [
        panels.ingest_with_warmup(df, "d", a, run_status, end=b, warmup=1, step=MONTH)
        for a, b in zip(cuts, cuts[1:])
    ]
    assert sorted(sum((rows(p) for p in parts), []), key=lambda t: tuple(map(str, t))) == whole


def test_a_load_reads_its_own_rows_and_the_state(spark, tmp_path):
    accounts = spark.createDataFrame(random_accounts(5), SCHEMA)
    whole = run_status(accounts)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    starts = [month(i) for i in range(0, 37, 6)]

    def load(start, end):
        # Nothing but the rows of the load is at hand.
        own = accounts.where((F.col("d") >= start) & (F.col("d") < end))
        panels.load_range(own, table, state, "d", start, end, run_status, step=MONTH)

    def loaded():
        return rows(panels.read_loaded(spark, table, whole.schema).select(*whole.columns))

    for start, end in zip(starts, starts[1:]):
        load(start, end)
    expected = rows(whole.where((F.col("d") >= starts[0]) & (F.col("d") < starts[-1])))
    assert expected and loaded() == expected
    load(starts[1], starts[2])
    load(starts[0], starts[1])
    assert loaded() == expected
    kept = spark.read.parquet(state).select(panels.PERIOD).distinct().count()
    assert kept <= len(starts) - 1


def test_stored_products_merge_without_an_exchange(spark):
    keys = ["id", "m"]
    base = spark.range(200).select((F.col("id") % 40).alias("id"), (F.col("id") % 5).alias("m"), F.col("id").alias("x")).dropDuplicates(keys)
    stored = session.colocate(base, keys)
    products = {
        name: balances.rollup_consumer(session.colocate(base.select("id", F.col("m").alias("ref"), F.col("x").alias(name)), ["id", "ref"]).withColumnRenamed("ref", "m"), keys, [name])
        for name in ("a", "b")
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = joins.merge_products(stored, products, keys)
    found, plan = rows(out), out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert found == rows(joins.merge_products(base, {n: base.select(*keys, F.col("x").alias(n)) for n in ("a", "b")}, keys))
