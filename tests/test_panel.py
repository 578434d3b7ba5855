"""Window and single-pass forms against the plain definitions, on random panels."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from creditloom.functions.dates import DAY, MONTH
from creditloom.operators import asof, ratings, reshape, status, tenure
from tests.conftest import rows

c = F.col


def month(i):
    return dt.date(2015 + i // 12, i % 12 + 1, 1)


def shift(d, n):
    i = (d.year * 12 + d.month - 1) + n
    return dt.date(i // 12, i % 12 + 1, d.day if d.day < 28 else 28)


def random_accounts(seed, ids=12, periods=24):
    rng = random.Random(seed)
    out = []
    for i in range(ids):
        for t in range(periods):
            if rng.random() < 0.35:
                continue
            bal = rng.choice([0, 0, 50, 100, None])
            out.append(
                (i, month(t), bal, rng.choice([0, 50, 100]), rng.choice(["Y", "N", None]),
                 rng.choice(["M", "R", None]), rng.choice([month(t), shift(month(t), -7), None]), i * 100 + t)
            )
    return out


SCHEMA = "id long, d date, bal long, chg long, closed string, typ string, opened date, payload long"


def run_status(df):
    return status.prev_period_status(df, "id", "d", "bal", "chg", "closed", "typ", "opened")


def expected_status(data):
    """Two-valued re-statement of the rules, one row at a time."""
    by_key = {(r[0], r[1]): r for r in data if r[0] is not None}
    out = []
    for r in data:
        i, d, bal, chg, closed, typ, opened, payload = r
        last = by_key.get((i, shift(d, -1)))
        wo = bal is not None and bal > 0 and chg >= bal
        new_file = "exist" if last else "new" if opened and opened >= shift(d, -6) else "legacy"
        if bal == 0 and (closed == "Y" or typ in ("M", "I")):
            terminal = "PD"
        elif wo:
            terminal = "WO"
        elif bal is not None and bal > 0 and closed == "Y":
            terminal = "AC"
        else:
            terminal = "N"
        new = 0
        if last:
            lb, lc, lclosed, ltyp = last[2], last[3], last[4], last[5]
            # AND is false if any part is false, unknown if the rest is unknown.
            parts = [None if lb is None else lb == 0, None if bal is None else bal == 0]
            ends = [None if lclosed is None else lclosed == "Y", None if ltyp is None else ltyp in ("M", "I")]
            end = True if True in ends else None if None in ends else False
            paid = False if False in [*parts, end] else None if None in [*parts, end] else True
            if paid is not False:
                continue
            was = None if lb is None else lb > 0 and lc >= lb
            if was is False and wo:
                new = chg
        if new_file == "legacy" and terminal == "PD":
            continue
        out.append((i, d, payload, new_file, terminal, new))
    return sorted(out, key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_status_equals_row_by_row_rules(spark, seed):
    data = random_accounts(seed)
    got = rows(run_status(spark.createDataFrame(data, SCHEMA)), "id", "d", "payload", "new_file", "terminal", "chargoff_new")
    assert got == expected_status(data)


def test_status_rows_without_id_never_match(spark):
    data = [(None, month(t), 50, 0, "N", "R", None, t) for t in range(5)]
    out = run_status(spark.createDataFrame(data, SCHEMA))
    assert rows(out, "payload", "new_file") == [(t, "legacy") for t in range(5)]


@pytest.mark.parametrize("block", [1, 2, 5])
def test_status_does_not_depend_on_the_block_length(spark, monkeypatch, block):
    data = random_accounts(11)
    monkeypatch.setattr(status, "BLOCK", block)
    got = rows(run_status(spark.createDataFrame(data, SCHEMA)), "id", "d", "payload", "new_file", "terminal", "chargoff_new")
    assert got == expected_status(data)


def test_status_splits_a_dominant_account(spark):
    """One account with a third of all rows: no window group is longer than a block."""
    start = dt.date(2000, 1, 1)
    hot = [(0, start + dt.timedelta(days=t), 50, 0, "N", "R", None, t) for t in range(3000)]
    rest = [(1 + t % 600, start + dt.timedelta(days=t % 10), 50, 0, "N", "R", None, t) for t in range(6000)]
    df = spark.createDataFrame(hot + rest, SCHEMA).dropDuplicates(["id", "d"])
    out = status.prev_period_status(df, "id", "d", "bal", "chg", "closed", "typ", None, step=DAY)
    assert out.where("id = 0 AND new_file = 'exist'").count() == 2999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan.split("hashpartitioning(id")[1].split(")")[0]


def random_reports(seed):
    rng = random.Random(seed)
    out = []
    for i in range(10):
        for t in range(18):
            if rng.random() < 0.3:
                continue
            lag = rng.choice([0, 1, 1, 1, 2, 5])
            day = rng.choice([1, 5, 28])
            reported = None if rng.random() < 0.1 else shift(month(t + 12), -lag).replace(day=day)
            out.append((i, month(t + 12), reported, rng.choice(["PD", "N", "WO"])))
    return out


@pytest.mark.parametrize("seed, block", [(4, 64), (5, 64), (6, 1), (7, 2), (8, 5)])
def test_asof_equals_range_join(spark, monkeypatch, seed, block):
    monkeypatch.setattr(asof, "BLOCK", block)
    data = random_reports(seed)
    df = spark.createDataFrame(data, "id long, run date, rep date, terminal string")
    refs = {(i, run) for i, run, _, _ in data} | {
        (i, shift(rep, 1).replace(day=1)) for i, _, rep, _ in data if rep
    }
    latest = defaultdict(lambda: dt.date.min)
    for i, run, rep, _ in data:
        latest[i, rep] = max(latest[i, rep], run)
    chosen = {}
    for i, ref in refs:
        fits = [run for (j, rep), run in latest.items() if j == i and rep and shift(ref, -3) <= rep <= ref]
        chosen[i, ref] = max(fits, default=None)
    got = asof.asof_latest_report(df, "id", "run", "rep").where("ref_date IS NOT NULL")
    assert {(r.id, r.ref_date): r.select_run_date for r in got.collect()} == chosen

    by_run = {(i, run): (rep, terminal) for i, run, rep, terminal in data}
    kept = set()
    for (i, ref), run in chosen.items():
        if run is None:
            continue
        rep, terminal = by_run[i, run]
        if not (terminal == "PD" and ref >= shift(rep, 1)):
            kept.add((i, ref, run))
    built = asof.rebuild_as_of(df, "id", "run", "rep", "terminal")
    found = [(r.id, r.ref_date, r.run) for r in built.collect()]
    assert len(found) == len(set(found)) and set(found) == kept


def test_rebuild_as_of_exchanges_its_rows_once(spark, frame):
    df = frame("id long, run date, rep date, terminal string, x int", (1, "2015-03-01", "2015-02-05", "N", 4), (None, "2015-03-01", "2015-02-05", "N", 5))
    built = asof.rebuild_as_of(df, "id", "run", "rep", "terminal")
    assert rows(built, "id", "ref_date", "run", "x") == [(1, dt.date(2015, 3, 1), dt.date(2015, 3, 1), 4)]
    plan = built._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    # Only the copy ahead of a block's end lies below the exchange.
    assert plan.split("Exchange ")[1].count("Generate ") == 1
    chosen = asof.asof_latest_report(df, "id", "run", "rep")._jdf.queryExecution().executedPlan().toString()
    assert chosen.split("== Initial Plan ==")[-1].count("Exchange ") == 1


@pytest.mark.parametrize("seed", [7, 8])
def test_stay_duration_equals_triangular_join(spark, seed):
    rng = random.Random(seed)
    data = [
        (rng.randrange(4), rng.choice(["a", "b", None]), month(rng.randrange(20)))
        for _ in range(150)
    ]
    weight = lambda d: 1 if d.year >= 2016 else 3
    expected = {}
    for i, loc, d in data:
        past = [p for j, l, p in data if j == i and l == loc and loc is not None and p < d]
        total, first = expected.get((i, loc, d), (0, None))
        expected[i, loc, d] = (total + sum(map(weight, past)), min(past, default=None))
    df = spark.createDataFrame(data, "id long, loc string, d date")
    out = tenure.stay_duration(
        df, "id", ["loc"], "d", F.when(F.year("d") >= 2016, 1).otherwise(3), month(0)
    )
    got = {(r.id, r["loc"], r.d): (r.stay_dur, r.stay_censored) for r in out.collect()}
    assert got == {k: (t, int(f == month(0))) for k, (t, f) in expected.items()}


def test_spells(frame):
    df = frame(
        "id long, d date",
        (1, "2016-01-01"), (1, "2016-02-01"), (1, "2016-02-01"), (1, "2016-05-01"), (1, "2016-12-01"), (1, "2017-01-01"),
    )
    got = rows(reshape.spells(df, "id", "d", MONTH), "spell", "spell_length", "max_spell")
    assert got == [(1, 2, 3), (2, 1, 3), (3, 2, 3)]


def test_revision_and_deferral(frame):
    df = frame(
        "id long, d date, mop string, pat string, reviewed int, treated int",
        (1, "2016-04-01", "1", "", 10, 1), (1, "2016-08-01", "4", "", 14, 1),
        (1, "2016-09-01", "5", "", 15, 1), (1, "2016-12-01", "1", "", 18, 1),
        (1, "2017-02-01", "1", "1111X1", 20, 1),
        (2, "2016-08-01", "4", "", 14, 1), (2, "2016-11-01", "4", "", 17, 1),
        (3, "2016-08-01", "4", "", 14, 0), (4, "2016-08-01", "4", "", None, 1),
    )
    start, rev = dt.date(2016, 6, 1), dt.date(2017, 2, 1)
    facts = ratings.revision_facts(df, "id", "d", "pat", "reviewed", rev)
    out = ratings.revise_from_history(df, facts, "id", "d", "mop", "reviewed", start, rev, "mop_rev")
    by = {(r.id, str(r.d)): r.mop_rev for r in out.collect()}
    # Position 7 lies beyond the six marks and reads as ''; position 6 and 3 hold a mark.
    assert by[1, "2016-08-01"] == "" and by[1, "2016-09-01"] == "1" and by[1, "2016-12-01"] == "1"
    assert by[1, "2016-04-01"] == "1" and by[2, "2016-08-01"] == "4"
    day = lambda m: dt.date(2016, m, 1)
    adjusted = ratings.deferral_adjust(
        out, "id", "d", "mop_rev", c("treated") == 1, (day(3), day(5)), (day(6), day(10)), (day(11), day(12)), "adj"
    )
    got = {(r.id, str(r.d)): r.adj for r in adjusted.collect()}
    assert got[1, "2016-08-01"] == "1"  # '' counts as bad, and the account is clean around it
    assert got[2, "2016-08-01"] == "4"  # still bad afterwards
    assert got[3, "2016-08-01"] == "4"  # not treated
    assert got[4, "2016-08-01"] == "1"


def test_first_location_skips_incomplete_addresses(frame):
    df = frame(
        "id long, d date, a string, b string",
        (1, "2016-01-01", "x", None), (1, "2016-02-01", "y", "u"), (1, "2016-03-01", "z", "v"), (2, "2016-01-01", None, "u"),
    )
    out = ratings.attach_first_location(df, "id", "d", ["a", "b"], ["a", "b"], "_o")
    assert {(r.id, r.a_o, r.b_o) for r in out.collect()} == {(1, "y", "u"), (2, None, None)}


def test_repeated_account_months_give_a_row_per_match(spark):
    rows = [
        (1, dt.date(2015, 1, 1), 50, 0, "N", "R", None, 1), (1, dt.date(2015, 1, 1), 60, 70, "N", "R", None, 2),
        (1, dt.date(2015, 2, 1), 60, 70, "N", "R", None, 3), (2, dt.date(2015, 2, 1), 10, 0, "N", "R", None, 4),
    ]
    out = run_status(spark.createDataFrame(rows, SCHEMA)).where("d = DATE '2015-02-01'").collect()
    found = sorted((r.id, r.new_file, r.chargoff_new) for r in out)
    assert found == [(1, "exist", 0), (1, "exist", 70), (2, "legacy", 0)]


def test_provinces_are_searched_for(frame):
    from creditloom.operators import region

    df = frame(
        "fsa string, prov string, km double",
        ("T9H", "AB", 0.0), ("A1A", "AB ", 200.0), ("A1B", "SASK", 200.0), ("A1C", "ON", 200.0), ("A1D", "AB", 50.0), ("A1E", None, 200.0),
    )
    out = region.keep_study_units(region.assign_groups(df, "fsa", "T9[HJK]", "prov", ["AB", "SK"], "km"))
    assert sorted(r.fsa for r in out.collect()) == ["A1A", "A1B", "T9H"]
