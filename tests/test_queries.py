"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import workload.queries  # noqa: F401
from workload import registry, views
from workload.check import compare

SF_DIR = "/root/testdata/sf0.001"
# The smallest tables leave the treated unit of the fits with holes.
FIT_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in views.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


# The region panels run every family through every stage; the single stages of each family are
# compared by ``python -m workload.check``.
STAGES = ("pipe_trade_clean", "pipe_time_adjust_", "pipe_consumer_loans", "pipe_region_facts")


@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLES if not n.startswith(STAGES)))
def test_query_equals_sql(spark, con, name):
    verdict = compare(spark, con, name, SF_DIR)
    assert verdict.startswith(("equal", "~9")), verdict


# Rows that must not be there, by SQL over the rows that a query without a SQL form of its own returned.
PATHS = "SELECT * FROM got WHERE NOT abs(gap - (y1 - y0)) <= 1e-9 * greatest(abs(y1), abs(y0), 1) OR pre NOT IN (0, 1)"
GAPS = "SELECT variant, run_date FROM got GROUP BY 1, 2 HAVING COUNT(*) <> COUNT(DISTINCT unit_id) OR COUNT(DISTINCT pre) <> 1"
WEIGHTS = """SELECT variant, job FROM {rows} GROUP BY ALL
    HAVING abs(SUM(weight) - 1) > 1e-9 OR min(weight) < 0 OR COUNT(*) <> COUNT(DISTINCT donor)
      OR COUNT(*) <> (SELECT COUNT(DISTINCT job) FROM got) - 1 OR bool_or(CAST(donor AS VARCHAR) = job)"""
FORBIDDEN = {
    "scm_weights": WEIGHTS.format(rows="got"),
    "scm_nested_fit": WEIGHTS.format(rows="(SELECT * FROM got WHERE kind = 'w')")
    + " UNION ALL SELECT variant, job FROM got GROUP BY ALL HAVING COUNT(DISTINCT loss) <> 1 OR bool_or(kind = 'failed')"
    + " UNION ALL SELECT variant, job FROM got WHERE kind = 'v' GROUP BY ALL HAVING abs(SUM(weight) - 1) > 1e-9 OR min(weight) < 0",
    "scm_leave_one_out": PATHS + " OR job NOT LIKE '7-%' OR job = '7-7'",
    "scm_backdated": PATHS + " OR pre <> CAST(run_date <= DATE '1997-07-01' AS INT)",
    "pipe_scm": "SELECT * FROM got WHERE lower > upper",
    "pipe_scm_card": GAPS,
    "pipe_scm_score": GAPS,
    "pipe_scm_loo": PATHS,
    "pipe_scm_backdated": PATHS + " OR pre <> CAST(run_date <= DATE '2015-11-01' AS INT)",
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_keeps_its_invariants(spark, con, name):
    got = registry.QUERIES[name](spark, FIT_DIR).toPandas()
    assert len(got) and con.execute(FORBIDDEN[name]).fetchall() == []


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
