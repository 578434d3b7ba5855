import math
import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import balances, clean, joins, quality, region, reshape, spatial, status
from creditloom.session import cut_lineage
from tests.conftest import rows, tidy

c = F.col


def test_left_attach_keeps_every_null_key_row(spark):
    df = spark.range(1000).select(
        F.when(c("id") % 3 == 0, None).otherwise(c("id") % 10).alias("k"), c("id").alias("v")
    )
    facts = spark.createDataFrame([(1, "a"), (None, "never")], "k long, f string")
    for spread in (False, True):
        out = joins.left_attach(df, facts, ["k"], spread_nulls=spread)
        assert out.count() == 1000 and out.columns == ["k", "v", "f"]
        assert out.where("k IS NULL AND f IS NOT NULL").count() == 0
        assert out.where("f = 'a'").count() == df.where("k = 1").count()


def test_group_size_is_null_for_unknown_groups(frame):
    df = frame("g long, h long", (1, 5), (1, None), (2, 7), (None, 9))
    assert rows(status.with_group_size(df, ["g"], "h", "n")) == tidy(
        [(1, 5, 1), (1, None, 1), (2, 7, 1), (None, 9, None)]
    )


def test_full_merge_null_keys_stay_apart(frame):
    a = frame("k long, p string, x long", (1, "l", 10), (None, "l", 20))
    b = frame("k long, p string, y long", (1, "r", 5), (2, "r", 6), (None, "r", 7))
    out = joins.full_merge(a, b, ["k"], ["p"])
    # Numeric keys are zero filled too, as every numeric column is.
    assert rows(out, "k", "p", "x", "y") == [(0, "l", 20, 0), (0, "r", 0, 7), (1, "l", 10, 5), (2, "r", 0, 6)]


def test_merge_products_fills_base_columns_by_default(frame):
    base = frame("id long, score int, name string", (1, None, None), (2, 700, "b"))
    loans = frame("id long, bal long", (2, 9))
    out = joins.merge_products(base, {"ml": loans}, ["id"])
    assert rows(out) == [(1, 0, None, 0, 0), (2, 700, "b", 9, 1)]
    kept = joins.merge_products(base, {"ml": loans}, ["id"], fill_cols=["bal"])
    assert rows(kept, "id", "score", "bal") == [(1, None, 0), (2, 700, 9)]


def brute(units, sites):
    def km(a, b):
        la, lb = math.radians(a[0]), math.radians(b[0])
        cos = math.cos(la) * math.cos(lb) * math.cos(math.radians(a[1] - b[1])) + math.sin(la) * math.sin(lb)
        return 111.045 * math.degrees(math.acos(min(1.0, cos)))

    return [min(km(u, s) for s in sites) for u in units]


def _random_places(rng, spread):
    """Places of one kind: a province, the whole sphere, around a pole, on both sides of the date line, one town."""
    return {
        "province": lambda: (rng.uniform(49, 60), rng.uniform(-120, -101)),
        "sphere": lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180)),
        "pole": lambda: (rng.choice([90.0, -90.0, rng.uniform(89, 90), rng.uniform(-90, -89)]), rng.uniform(-180, 180)),
        "date line": lambda: (rng.uniform(-1, 1), rng.choice([180.0, -180.0, rng.uniform(179, 180), rng.uniform(-180, -179)])),
        "town": lambda: (rng.uniform(56.70, 56.71), rng.uniform(-111.41, -111.40)),
    }[spread]()


@pytest.mark.parametrize(
    "of_units, of_sites",
    [("province", "province"), ("sphere", "sphere"), ("pole", "pole"), ("date line", "date line"), ("sphere", "town"), ("town", "sphere"), ("town", "town")],
)
def test_min_distance_equals_brute_force(spark, of_units, of_sites):
    rng = random.Random(f"{of_units} {of_sites}")
    units = [_random_places(rng, of_units) for _ in range(60)]
    sites = [_random_places(rng, of_sites) for _ in range(40)]
    units += [sites[0], units[0]]
    schema = "latitude double, longitude double"
    u = spark.createDataFrame([(i, *p) for i, p in enumerate(units)] + [(99, None, 1.0)], "i int, " + schema)
    out = spatial.min_distance(u, spark.createDataFrame([*sites, (None, 2.0)], schema))
    got = {r.i: r.distance_min for r in out.collect()}
    assert got.pop(99) is None
    assert [got[i] for i in range(len(units))] == pytest.approx(brute(units, sites), abs=2e-4)
    assert out.columns == ["i", "latitude", "longitude", "distance_min"]


def test_few_site_cells_are_left_for_a_unit(spark):
    rng = random.Random(3)
    sites = spark.createDataFrame([_random_places(rng, "province") for _ in range(3000)], "latitude double, longitude double")
    units = spark.createDataFrame([_random_places(rng, "province") for _ in range(200)], "latitude double, longitude double")
    pairs = spatial._nearest_cells(spatial._points(units, "latitude", "longitude"), spatial._points(sites, "latitude", "longitude"))
    assert pairs.count() < 10 * 200


def test_min_distance_without_sites(spark):
    u = spark.createDataFrame([(50.0, -110.0)], "latitude double, longitude double")
    assert spatial.min_distance(u, u.where("latitude < 0")).first().distance_min is None


def test_checked_broadcast_leaves_large_lookups_alone(spark):
    lookup = spark.range(100)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(joins.checked_broadcast(lookup, 100)) and not hinted(joins.checked_broadcast(lookup, 99))


def test_product_filter_drops_unknown_types(frame):
    df = frame("product_type string, acct_type string", ("AL", "I"), ("AL", "M"), ("UT", "I"), (None, "I"), ("AL", None))
    assert df.where(clean.product_filter("OTHER")).count() == 1


def test_active_counts_are_null_when_none_or_place_unknown(frame):
    schema = "k long, p string, id long, current_balance long, mop string, terminal string, chargoff_refine long, chargoff_new long, cr_lmt long"
    df = frame(
        schema,
        (1, "a", 1, 10, "4", "N", 0, 0, 100), (1, "a", 2, 20, "7", "WO", 20, 20, 100),
        (1, "b", 3, 0, "1", "PD", 0, 0, 100), (1, None, 4, 30, "X", "AC", 0, 0, 100),
    )
    out = balances.consumer_loans(df, ["k", "p"], "ml", "id", nullable_keys=["p"])
    assert rows(out, "p", "ml_bal", "ml_bal_arr", "ml_chargoff_new", "n_ml", "ml_lmt") == tidy(
        [("a", 10, 10, 20, 1, 100), ("b", 0, 0, 0, None, None), (None, 30, 0, 0, None, None)]
    )


def test_panel_measures_with_a_dominant_region(spark):
    """A third of all rows in one region; consumers repeat within a month."""
    n = 3000
    df = spark.range(n).select(
        F.when(c("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (c("id") % 50).cast("string"))).alias("region"),
        (c("id") % 700).alias("consumer"),
        c("id").alias("x"),
    )
    m = region.PanelMeasures("consumer")
    m.distinct("n")
    m.distinct("n_even", c("x") % 2 == 0)
    m.total("x_sum", c("x"))
    m.mean("x_mean_even", c("x"), c("x") % 2 == 0)
    got = {r.region: r for r in m.apply(df, ["region"]).collect()}
    pdf = df.toPandas()
    for name, part in pdf.groupby("region"):
        even = part[part.x % 2 == 0]
        assert got[name].n == part.consumer.nunique() and got[name].n_even == even.consumer.nunique()
        assert got[name].x_sum == part.x.sum()
        want = even.x.mean() if len(even) else None
        assert got[name].x_mean_even == (pytest.approx(want) if want is not None else None)


def test_eligibility_forms_agree(frame):
    df = frame(
        "treated int, fsa string, month int, n long",
        (0, "T2A", 1, 6), (0, "T2A", 2, 5), (0, "S4P", 1, 9), (0, "S4P", 2, 4), (1, "T9", 1, 1),
    )
    listed = region.keep_groups(df, region.eligible_groups(df, ["treated", "fsa"], "n", 5), ["treated", "fsa"])
    inline = region.keep_eligible(df, ["treated", "fsa"], "n", 5)
    assert rows(listed, "fsa", "month") == rows(inline, "fsa", "month") == [("T2A", 1), ("T2A", 2), ("T9", 1)]


def test_unit_ids_follow_the_sorted_names(spark):
    names = [f"{a}{b}{i}" for a in "TSB" for b in "19" for i in range(7)] + ["T9(H|J|K)"]
    df = spark.createDataFrame([(n,) for n in names * 2], "fsa string")
    got = {r.fsa: r.unit_id for r in reshape.unit_ids(df, "fsa").collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}


def test_unit_ids_split_a_shared_prefix(spark, monkeypatch):
    written = []
    monkeypatch.setattr(reshape, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    df = spark.range(20_000).select(F.format_string("same prefix %06d", "id").alias("fsa"))
    ids = reshape.unit_ids(df, "fsa")
    wrong = ids.where("unit_id <> cast(substr(fsa, 13) as int) + 1").count()
    tasks = written[0].select(F.shiftright("__at", 33)).distinct().count()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert wrong == 0 and ids.count() == 20_000 and tasks > 8


def test_full_merge_splits_a_hot_key(spark):
    """A third of either side's work on one key runs in several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    hot = F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id"))
    a = spark.range(0, 40_000, numPartitions=12).select(hot.alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
    b = spark.range(30_000, 70_000, numPartitions=12).where("id % 2 = 1").select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("y"))
    out = joins.full_merge(a, b, ["k"])
    n = len(out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == 40_000 + 15_000
    assert "FullOuter" not in plan and "skew=true" in plan


def test_sample_takes_whole_entities_whatever_the_layout(spark):
    df = spark.range(5000).select((c("id") % 1000).alias("k"), "id")
    a = reshape.sample_entities(df, "k", 0.2, 1983)
    b = reshape.sample_entities(df.repartition(7), "k", 0.2, 1983)
    assert rows(a) == rows(b) and {r["count"] for r in a.groupBy("k").count().collect()} == {5}
    assert 120 < a.select("k").distinct().count() < 280
    assert reshape.sample_entities(df, "k", 1.0, 1983).count() == 5000


def test_location_change_counts_unknown_as_different(frame):
    df = frame("a string, b string", ("x", "x"), ("x", None), (None, None))
    assert [r.loc_chg for r in quality.location_change(df, "a", "b").collect()] == [0, 1, 0]
