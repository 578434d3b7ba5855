"""Synthetic control on a region panel: matrices, fits, paths, placebo tests, confidence sets.

Sizes: the panel has one row per region and period, so everything here is bounded by the number
of regions N and periods T, however large the micro data are.  The placebo study needs every region
against every other, which is the N × (N − 1) weight table it returns.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.functions.dates import quarter_label
from creditloom.operators import simplex

VARIANT = "variant"


@dataclass(frozen=True)
class ScmSpec:
    """What to fit: outcome, predictors, event window and end of the pre-treatment window."""

    outcome: str
    level: str
    series: tuple[str, ...]
    quarters: tuple[str, ...]
    window: tuple[dt.date, dt.date]
    t0: dt.date

    def backdate(self, t0: dt.date, last_quarter: str) -> "ScmSpec":
        """The same study as if treatment had started earlier."""
        kept = tuple(q for q in self.quarters if quarter_order(q) <= quarter_order(last_quarter))
        return replace(self, t0=t0, quarters=kept)


def quarter_order(label: str) -> tuple[int, int]:
    """Year and quarter of a label such as yr99_q4; two-digit years from 50 on are of the 1900s."""
    year, quarter = label.removeprefix("yr").split("_q")
    return int(year) + (1900 if int(year) >= 50 else 2000), int(quarter)


def event_window(df: DataFrame, date: str, spec: ScmSpec, pre: str = "pre") -> DataFrame:
    """Rows of the event window with a flag for the pre-treatment part."""
    inside = df.where(F.col(date).between(*[F.lit(d) for d in spec.window]))
    return inside.withColumn(pre, F.when(F.col(date) <= F.lit(spec.t0), 1).otherwise(0))


def predictors(
    panel: DataFrame, spec: ScmSpec, unit: str = "unit_id", date: str = "run_date"
) -> DataFrame:
    """(variant, unit, predictor, value): pre-window mean of the level and quarter means of each series.

    A unit without any observation in a quarter has no row for it.
    """
    rows = event_window(panel, date, spec).withColumn("__q", quarter_label(F.col(date)))
    wanted = {f"{spec.level}": F.avg(F.when(F.col("pre") == 1, F.col(spec.level)))}
    for series in spec.series:
        for quarter in spec.quarters:
            inside = F.when(F.col("__q") == quarter, F.col(series))
            wanted[f"{series}.{quarter}"] = F.avg(inside)
    names = list(wanted)
    wide = rows.groupBy(VARIANT, unit).agg(
        *[wanted[name].alias(f"p{i}") for i, name in enumerate(names)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("predictor"), F.col(f"p{i}").cast("double").alias("value"))
            for i, name in enumerate(names)
        ]
    )
    return wide.select(VARIANT, unit, F.inline(pairs)).where(F.col("value").isNotNull())


def outcomes(
    panel: DataFrame, spec: ScmSpec, unit: str = "unit_id", date: str = "run_date"
) -> DataFrame:
    """(variant, unit, date, y, pre) over the event window."""
    return event_window(panel, date, spec).select(
        VARIANT, unit, date, F.col(spec.outcome).cast("double").alias("y"), "pre"
    )


def complete_units(
    predictor_rows: DataFrame, outcome_rows: DataFrame, unit: str = "unit_id", date: str = "run_date"
) -> DataFrame:
    """(variant, unit) of units observed in every period and predictor of their variant.

    One unit with a hole would make every fit fail that has it as a donor.  ``incomplete_units`` names
    the others.
    """
    missing = F.col("missing_periods") + F.col("missing_predictors")
    return unit_holes(predictor_rows, outcome_rows, unit, date).where(missing == 0).select(VARIANT, unit)


def incomplete_units(
    predictor_rows: DataFrame, outcome_rows: DataFrame, unit: str = "unit_id", date: str = "run_date"
) -> DataFrame:
    """(variant, unit, missing_periods, missing_predictors) of the units that cannot be fitted."""
    missing = F.col("missing_periods") + F.col("missing_predictors")
    return unit_holes(predictor_rows, outcome_rows, unit, date).where(missing > 0)


def unit_holes(
    predictor_rows: DataFrame, outcome_rows: DataFrame, unit: str = "unit_id", date: str = "run_date"
) -> DataFrame:
    """How many periods and predictors of its variant each unit lacks."""
    seen = (
        outcome_rows.groupBy(VARIANT, unit)
        .agg(F.count("y").alias("__ny"))
        .join(
            predictor_rows.groupBy(VARIANT, unit).agg(F.count("value").alias("__nx")),
            [VARIANT, unit],
            "full",
        )
        .fillna(0, subset=["__ny", "__nx"])
    )
    # A period or predictor exists in a variant once any of its units has it.
    full = (
        outcome_rows.groupBy(VARIANT)
        .agg(F.countDistinct(date).alias("__fy"))
        .join(predictor_rows.groupBy(VARIANT).agg(F.countDistinct("predictor").alias("__fx")), VARIANT)
    )
    return seen.join(full, VARIANT).select(
        VARIANT,
        unit,
        (F.col("__fy") - F.col("__ny")).alias("missing_periods"),
        (F.col("__fx") - F.col("__nx")).alias("missing_predictors"),
    )


def placebo_jobs(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """One fit per unit, each with all other units as donors: (variant, job, treated, dropped)."""
    return units.select(
        VARIANT,
        F.col(unit).cast("string").alias("job"),
        F.col(unit).cast("long").alias("treated"),
        F.lit(None).cast("long").alias("dropped"),
    )


def treated_job(units: DataFrame, treated: int, unit: str = "unit_id") -> DataFrame:
    """The single job of each variant that fits the treated unit; it fails where that unit is missing."""
    one = units.select(VARIANT).distinct().withColumn("__unit", F.lit(treated))
    return placebo_jobs(one, "__unit")


def leave_one_out_jobs(
    units: DataFrame, weights: DataFrame, treated: int, unit: str = "unit_id", tolerance: float = 1e-6
) -> DataFrame:
    """One fit of the treated unit per donor with a positive weight, without that donor."""
    used = weights.where((F.col("job") == str(treated)) & (F.col("weight") > tolerance))
    present = units.select(VARIANT, F.col(unit).alias("donor"))
    return used.join(present, [VARIANT, "donor"], "left_semi").select(
        VARIANT,
        F.concat(F.lit(f"{treated}-"), F.col("donor").cast("string")).alias("job"),
        F.lit(treated).cast("long").alias("treated"),
        F.col("donor").cast("long").alias("dropped"),
    )


def pack_units(
    predictor_rows: DataFrame,
    outcome_rows: DataFrame,
    units: DataFrame | None = None,
    unit: str = "unit_id",
    date: str = "run_date",
) -> DataFrame:
    """One row per unit with its predictor vector and its pre-treatment outcome vector.

    ``units`` are those that take part in the fits, if not all.
    """
    x = predictor_rows.groupBy(VARIANT, unit).agg(
        F.array_sort(F.collect_list(F.struct("predictor", "value"))).alias("x")
    )
    y = (
        outcome_rows.where(F.col("pre") == 1)
        .groupBy(VARIANT, unit)
        .agg(F.array_sort(F.collect_list(F.struct(date, "y"))).alias("y"))
    )
    both = x.join(y, [VARIANT, unit])
    if units is not None:
        both = both.join(units, [VARIANT, unit], "left_semi")
    return both.select(
        VARIANT,
        unit,
        F.col("x.predictor").alias("names"),
        F.col("x.value").alias("x"),
        F.col("y.y").alias("y"),
    )


FIT_SCHEMA = (
    "variant string, job string, kind string, donor long, predictor string, weight double, "
    "loss double, converged boolean"
)
COLUMNS = ("variant", "job", "kind", "donor", "predictor", "weight", "loss", "converged")


def fit(
    jobs: DataFrame,
    packed: DataFrame,
    unit: str = "unit_id",
    nested: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Donor weights (kind 'w') and predictor weights (kind 'v') of every job.

    A job is one row. The jobs of a variant are dealt to ``tasks`` parts, and the packed units of the variant
    go once to each part: bytes grow with units × parts, not with units × jobs, and the jobs of a part share one
    matrix and its Gram matrix. A task holds the N unit vectors that any single fit needs. The explicit partition
    count keeps AQE from folding these small but compute-heavy groups into one task. A fit that fails yields a single
    row of kind 'failed'; ``converged`` tells whether the searches of the others met their stop rule.
    """
    tasks = tasks or jobs.sparkSession.sparkContext.defaultParallelism
    part = "__part"
    dealt = jobs.withColumn(part, F.pmod(F.xxhash64("job"), F.lit(tasks)).cast("int"))
    # Under another name: both frames may come from the same panel.
    named = packed.select(F.col(VARIANT).alias("__of"), *[c for c in packed.columns if c != VARIANT])
    copies = named.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def solve(mine: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        units = simplex.UnitMatrix(vectors, unit)
        rows = []
        for job in mine.itertuples():
            dropped = None if pd.isna(job.dropped) else int(job.dropped)
            head = {"variant": job.variant, "job": job.job}
            rows += [{**head, **row} for row in simplex.fit_job(units, int(job.treated), dropped, nested)]
        return _frame(rows, COLUMNS)

    left = dealt.repartition(tasks, VARIANT, part).groupBy(VARIANT, part)
    right = copies.repartition(tasks, "__of", part).groupBy("__of", part)
    return left.cogroup(right).applyInPandas(solve, FIT_SCHEMA)


def _frame(rows: list[dict], columns: Sequence[str]) -> pd.DataFrame:
    """Rows as a frame whose missing cells are None, so that text and ids stay typed by the schema."""
    cells = {c: [row.get(c) for row in rows] for c in columns}
    numeric = {"weight", "loss", "lower", "upper"}
    return pd.DataFrame(
        {c: pd.Series(v, dtype="float64" if c in numeric else "object") for c, v in cells.items()}
    )


def donor_weights(fitted: DataFrame) -> DataFrame:
    return fitted.where(F.col("kind") == "w").select(VARIANT, "job", "donor", "weight")


def predictor_weights(fitted: DataFrame) -> DataFrame:
    return fitted.where(F.col("kind") == "v").select(VARIANT, "job", "predictor", "weight")


def failed_units(fitted: DataFrame) -> DataFrame:
    return fitted.where(F.col("kind") == "failed").select(
        VARIANT, F.col("job").cast("long").alias("unit_id")
    )


def uniform_weights(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Equal donor weights for every unit; the reference point for checks."""
    jobs = units.select(VARIANT, F.col(unit).alias("__job"))
    both = units.select(VARIANT, F.col(unit).alias("donor")).join(jobs, VARIANT)
    pairs = both.where(F.col("donor") != F.col("__job")).select(VARIANT, F.col("__job").cast("string").alias("job"), "donor")
    sizes = pairs.groupBy(VARIANT, "job").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(sizes, [VARIANT, "job"]).select(
        VARIANT, "job", "donor", (F.lit(1.0) / F.col("n")).alias("weight")
    )


def drop_failed(weights: DataFrame, failed: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Remove failed units as jobs and as donors, and rescale each job's weights to sum to one."""
    gone = failed.select(VARIANT, F.col(unit).alias("donor"))
    jobs = failed.select(VARIANT, F.col(unit).cast("string").alias("job"))
    kept = weights.join(gone, [VARIANT, "donor"], "left_anti").join(
        jobs, [VARIANT, "job"], "left_anti"
    )
    totals = kept.groupBy(VARIANT, "job").agg(F.sum("weight").alias("__total"))
    return kept.join(totals, [VARIANT, "job"]).select(
        VARIANT,
        "job",
        "donor",
        F.try_divide(F.col("weight"), F.col("__total")).alias("weight"),
    )


def balance_table(
    predictor_rows: DataFrame, weights: DataFrame, treated: int, unit: str = "unit_id"
) -> DataFrame:
    """Each predictor for the treated unit, its synthetic twin and the mean of the donors."""
    own = weights.where(F.col("job") == str(treated)).select(
        VARIANT, F.col("donor").alias(unit), "weight"
    )
    rows = predictor_rows.join(own, [VARIANT, unit], "left")
    is_treated = F.col(unit) == treated
    return rows.groupBy(VARIANT, "predictor").agg(
        F.max(F.when(is_treated, F.col("value"))).alias("treated"),
        F.sum(F.col("weight") * F.col("value")).alias("synthetic"),
        F.avg(F.when(~is_treated, F.col("value"))).alias("sample_mean"),
    )


def paths(
    outcome_rows: DataFrame, weights: DataFrame, job_unit: Column | None = None,
    unit: str = "unit_id", date: str = "run_date",
) -> DataFrame:
    """(variant, job, date, y1, y0, gap, pre): treated and synthetic outcome of every job."""
    job_unit = F.split("job", "-")[0].cast("long") if job_unit is None else job_unit
    donors = outcome_rows.select(
        VARIANT, F.col(unit).cast("long").alias("donor"), date, F.col("y").alias("y_donor")
    )
    synthetic = (
        weights.withColumn("donor", F.col("donor").cast("long"))
        .join(donors, [VARIANT, "donor"])
        .groupBy(VARIANT, "job", date)
        .agg(F.sum(F.col("weight") * F.col("y_donor")).alias("y0"))
        .withColumn("__unit", job_unit)
    )
    own = outcome_rows.select(
        VARIANT, F.col(unit).cast("long").alias("__unit"), date, F.col("y").alias("y1"), "pre"
    )
    return synthetic.join(own, [VARIANT, "__unit", date]).select(
        VARIANT,
        "job",
        F.col("__unit").alias(unit),
        date,
        "y1",
        "y0",
        (F.col("y1") - F.col("y0")).alias("gap"),
        "pre",
    )


def rmspe_ratio(gaps: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Mean squared gap after treatment over the one before, per unit.

    A perfect fit before treatment gives infinity, as extreme as can be; without any gap, NULL.
    """
    square = F.col("gap") * F.col("gap")
    post = F.avg(F.when(F.col("pre") == 0, square))
    before = F.avg(F.when(F.col("pre") == 1, square))
    ratio = F.when((before == 0) & (post > 0), F.lit(float("inf"))).otherwise(F.try_divide(post, before))
    return gaps.groupBy(VARIANT, unit).agg(ratio.alias("ts"))


def placebo_pvalue(
    stats: DataFrame, treated: int, phi: float = 0.0, v: Column | None = None, unit: str = "unit_id"
) -> DataFrame:
    """Probability that a unit drawn with odds exp(phi · v) is at least as extreme as the treated one.

    Average ranks keep the order of the statistics, so comparing the statistics is enough.  A
    window group holds one statistic per unit.  Without a statistic of the treated unit there is
    nothing to compare: p-value and decision are NULL, and the status says so.
    """
    odds = F.exp(F.lit(phi) * (F.lit(0) if v is None else v).cast("double"))
    # The treated statistic comes from the same rows, so that it ties with itself to the last bit.
    own = F.max(F.when(F.col(unit) == treated, F.col("ts"))).over(Window.partitionBy(VARIANT))
    rows = stats.withColumns({"__odds": odds, "__own": own})
    extreme = F.when(F.col("ts") >= F.col("__own"), F.col("__odds")).otherwise(0.0)
    n = F.count(F.lit(1))
    level = F.ceil(F.lit(0.05) * n) / n
    known = F.max("__own").isNotNull()
    p = F.when(known, F.sum(extreme) / F.sum("__odds"))
    return rows.groupBy(VARIANT).agg(
        n.alias("n_unit"), p.alias("pvalue"), level.alias("alpha"),
        F.when(known, F.when(p <= level, 1).otherwise(0)).alias("reject"),
        F.when(known, "found").otherwise("no treated unit").alias("status"),
    )


FAMILIES = ("uniform", "constant", "linear")


def conf_coefs(
    gaps: DataFrame, weights: DataFrame, treated: int, family: str,
    unit: str = "unit_id", date: str = "run_date",
) -> DataFrame:
    """Per unit: the post-treatment mean square under a null path with parameter c is a + 2bc + kc².

    A null path only enters a unit's gap through the treated unit's weight in its synthetic twin
    (−1 for the treated unit itself), so one aggregation replaces re-evaluating all gaps per c.
    """
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    c = F.col
    dose = weights.where(c("donor") == treated).select(
        VARIANT, c("job").cast("long").alias(unit), c("weight").alias("__w")
    )
    post_own = gaps.where((c(unit) == treated) & (c("pre") == 0))
    # Number of each post-treatment period, over the treated unit's path of at most T rows.
    in_time = Window.partitionBy(VARIANT).orderBy(date)
    position = post_own.select(
        VARIANT, date, c("gap").alias("__own"),
        F.row_number().over(in_time).cast("double").alias("__k"),
    )
    rows = (
        gaps.join(dose, [VARIANT, unit], "left")
        .join(position, [VARIANT, date], "left")
        .withColumn("__w", F.when(c(unit) == treated, -1.0).otherwise(F.coalesce("__w", F.lit(0.0))))
    )
    base = c("gap") + c("__w") * c("__own") if family == "uniform" else c("gap")
    slope = c("__w") * (c("__k") if family == "linear" else F.lit(1.0))
    # Periods in which the treated unit itself is not observed carry no null path.
    post = (c("pre") == 0) & c("__k").isNotNull()
    own_gap = F.when(post & (c(unit) == treated), c("gap"))
    start = {
        "uniform": F.lit(0.0),
        "constant": F.avg(own_gap),
        "linear": F.try_divide(
            F.max_by(own_gap, F.when(post, c(date))), F.sum(F.when(post, 1.0))
        ),
    }[family]
    return rows.groupBy(VARIANT, unit).agg(
        F.avg(F.when(post, base * base)).alias("a"),
        F.avg(F.when(post, base * slope)).alias("b"),
        F.avg(F.when(post, slope * slope)).alias("k"),
        F.avg(F.when(c("pre") == 1, c("gap") * c("gap"))).alias("pre_ms"),
        start.alias("start"),
    )


def _nonnegative(a: Column, b: Column, k: Column) -> Column:
    """Where a + 2bc + kc² ≥ 0: an array of closed (lo, hi), for coefficients that are not null."""
    inf, none = F.lit(float("inf")), F.lit(None).cast("double")
    d = b * b - a * k
    q = -(b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(d, F.lit(0.0))))
    one, two = F.try_divide(q, k), F.coalesce(F.try_divide(a, q), F.lit(0.0))
    low, high = F.least(one, two), F.greatest(one, two)
    line = F.try_divide(-a, 2.0 * b)

    def spans(*ends: tuple[Column, Column]) -> Column:
        return F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in ends])

    never = F.filter(spans((none, none)), lambda x: x["lo"].isNotNull())
    return (
        F.when((k > 0) & (d > 0), spans((-inf, low), (high, inf)))
        .when((k > 0) | ((k == 0) & (b == 0) & (a >= 0)), spans((-inf, inf)))
        .when((k < 0) & (d >= 0), spans((low, high)))
        .when((k == 0) & (b > 0), spans((line, inf)))
        .when((k == 0) & (b < 0), spans((-inf, line)))
        .otherwise(never)
    )


def _rejected(coefs: DataFrame, own: DataFrame, phi: float, level: Column) -> DataFrame:
    """(variant, lo, hi, at_lo, at_hi): the open intervals of parameters that are rejected, and whether their ends are too.

    A unit is at least as extreme as the treated one where a quadratic is not negative. The ends of these spans are summed
    per place, and running counts over the places tell how many units are as extreme at a place and behind it.
    """
    c = F.col
    # Multiplied with both mean squares, so that a perfect fit before treatment is as extreme as can be.
    a, b, k = (c(n) * c("own_pre_ms") - c(f"own_{n}") * c("pre_ms") for n in ("a", "b", "k"))
    moves = (c("a") > 0) | (c("k") > 0)
    known = ~F.isnan(a + b + k) & (a + b + k).isNotNull() & ((c("pre_ms") > 0) | moves)
    rows = coefs.join(own, VARIANT).withColumn("spans", F.when(known, _nonnegative(a, b, k)))
    rows = rows.select(VARIANT, "v", F.explode("spans").alias("span"))
    ends = F.array(
        F.struct(c("span.lo").alias("x"), F.lit(1).alias("begins"), F.lit(0).alias("ends")),
        F.struct(c("span.hi").alias("x"), F.lit(0).alias("begins"), F.lit(1).alias("ends")),
    )
    rows = rows.select(VARIANT, "v", F.explode(ends).alias("e"))
    # Both ends of the line are places, whoever begins or ends there.
    edges = F.transform(F.array(F.lit(float("-inf")), F.lit(float("inf"))), lambda x: F.struct(x.alias("x"), F.lit(0).alias("begins"), F.lit(0).alias("ends")))
    rows = rows.unionByName(own.select(VARIANT, F.lit(0).alias("v"), F.explode(edges).alias("e")))
    names = [f"{kind}_{v}" for kind in ("begins", "ends") for v in (0, 1)]
    places = rows.groupBy(VARIANT, c("e.x").alias("x")).agg(
        *[F.sum(F.when(c("v") == int(n[-1]), c(f"e.{n[:-2]}")).otherwise(0)).alias(n) for n in names]
    )
    upward = Window.partitionBy(VARIANT).orderBy("x")
    so_far = upward.rowsBetween(Window.unboundedPreceding, 0)

    def rejected(at_place: bool) -> Column:
        held = [
            F.sum(c(f"begins_{v}") - c(f"ends_{v}")).over(so_far) + (c(f"ends_{v}") if at_place else F.lit(0)) for v in (0, 1)
        ]
        odds = math.exp(phi)
        return (held[0] + held[1] * odds) / (c("n_0") + c("n_1") * odds) <= c("level")

    totals = own.select(VARIANT, "n_0", "n_1", level.alias("level"))
    states = places.join(totals, VARIANT).select(VARIANT, "x", rejected(True).alias("at_lo"), rejected(False).alias("behind"))
    ahead = {"hi": F.lead("x").over(upward), "at_hi": F.lead("at_lo").over(upward)}
    return states.withColumns(ahead).where(c("behind") & c("hi").isNotNull()).select(VARIANT, c("x").alias("lo"), "hi", "at_lo", "at_hi")


def _steps(rejected: Column, start: Column, unit_step: Column, limit: Column, precision: int) -> Column:
    """Furthest place from ``start`` upward by steps of unit_step · 2^−power, each size repeated while the next place is not rejected."""

    def let(value, use):
        """``use`` of a value that is computed once."""
        return F.transform(F.array(value), use)[0]

    def first_hit(x, bound, step):
        """Number of the first step that ends in a rejected interval."""
        steps = F.greatest(F.lit(0.0), F.least((x["lo"] - bound) / step, F.lit(1e15)))
        first = let(steps, lambda n: F.greatest(F.lit(1.0), F.ceil(n) + F.when(x["at_lo"] | (F.ceil(n) > n), 0).otherwise(1)).cast("double"))

        def inside(j):
            place = bound + j * step
            return F.when((place < x["hi"]) | (x["at_hi"] & (place == x["hi"])), j)

        return let(first, inside)

    def refine(bound, power):
        step = unit_step * F.pow(F.lit(0.5), power.cast("double"))
        hit = F.array_min(F.transform(rejected, lambda x: first_hit(x, bound, step)))
        # Without a rejected place ahead, and beyond the limit, there is no bound.
        moved = let(hit, lambda j: F.coalesce(bound + (j - 1.0) * step, F.lit(float("inf"))))
        return let(moved, lambda m: F.when((m > bound) & (F.abs(m) > limit), F.lit(float("inf"))).otherwise(m))

    return F.aggregate(F.sequence(F.lit(0), F.lit(precision)), start.cast("double"), refine)


def conf_set(
    coefs: DataFrame, treated: int, family: str, precision: int = 30, phi: float = 0.0,
    v: Column | None = None, unit: str = "unit_id", significance: float | None = None,
) -> DataFrame:
    """(variant, lower, upper, status): bounds of the confidence set by test inversion.

    Where a unit is as extreme as the treated one are spans between roots, so the whole set of rejected parameters is known
    from sorted ends; the published search, with steps from 1 to 2^−precision on each side, is then replayed on it.
    A unit with a missing statistic is never extreme; without exactly one treated unit there are no bounds.
    """
    if precision != int(precision) or precision < 0 or phi < 0 or family not in FAMILIES:
        raise ValueError("precision must be a whole number, precision and phi must not be negative; family must be known")
    if significance is not None and not 0 < significance < 1:
        raise ValueError("significance must lie between 0 and 1")
    c = F.col
    v = (F.lit(0) if v is None else v).cast("double")
    checked = F.when(v.isin(0.0, 1.0), v.cast("int")).otherwise(F.raise_error(F.lit("v must be 0 or 1 for every unit")).cast("int"))
    rows = coefs.select(VARIANT, "a", "b", "k", "pre_ms", "start", checked.alias("v"), F.coalesce(c(unit) == treated, F.lit(False)).alias("is_own"))
    numbers = ("a", "b", "k", "pre_ms", "start")
    sizes = [F.sum(F.when(c("v") == i, 1).otherwise(0)).alias(f"n_{i}") for i in (0, 1)]
    own = rows.groupBy(VARIANT).agg(
        *[F.max(F.when(c("is_own"), c(n))).alias(f"own_{n}") for n in numbers], *sizes, F.sum(c("is_own").cast("int")).alias("n_own")
    )
    finite = [c(f"own_{n}").isNotNull() & (F.abs(f"own_{n}") < float("inf")) & ~F.isnan(f"own_{n}") for n in ("a", "b", "k")]
    n = c("n_0") + c("n_1")
    level = F.ceil(F.lit(0.05) * n) / n if significance is None else F.lit(float(significance))
    intervals = _rejected(rows.drop("start"), own.drop("own_start"), phi, level)
    intervals = intervals.groupBy(VARIANT).agg(F.collect_list(F.struct("lo", "hi", "at_lo", "at_hi")).alias("rejected"))
    found = own.join(intervals, VARIANT, "left").withColumns({
        "rejected": F.coalesce("rejected", F.array().cast("array<struct<lo: double, hi: double, at_lo: boolean, at_hi: boolean>>")),
        "known": (c("n_own") == 1) & reduce(Column.__and__, finite),
    })
    start, one, limit = c("own_start"), F.lit(1.0), F.lit(1e6)
    if family != "uniform":
        # Constant and linear sets move by multiples of the start value's size.
        one, limit = F.abs(start), 100.0 * F.abs(start)
    mirrored = F.transform("rejected", lambda x: F.struct((-x["hi"]).alias("lo"), (-x["lo"]).alias("hi"), x["at_hi"].alias("at_lo"), x["at_lo"].alias("at_hi")))
    hits = F.exists("rejected", lambda x: ((x["lo"] < start) & (start < x["hi"])) | (x["at_lo"] & (start == x["lo"])) | (x["at_hi"] & (start == x["hi"])))
    early = F.when(~c("known"), "no treated unit").when(hits, "empty").when(one == 0, "degenerate")
    found = found.withColumns({"early": early, "mirrored": mirrored}).withColumns({
        "upper": F.when(c("early").isNull(), _steps(c("rejected"), start, one, limit, precision)),
        "lower": F.when(c("early").isNull(), -_steps(c("mirrored"), -start, one, limit, precision)),
    })
    bounded = (F.abs("lower") < float("inf")) & (F.abs("upper") < float("inf"))
    status = F.coalesce("early", F.when(bounded, "found").otherwise("unbounded"))
    return found.select(VARIANT, *[F.when(bounded, c(e)).alias(e) for e in ("lower", "upper")], status.alias("status"))


def conf_band(
    gaps: DataFrame, bounds: DataFrame, treated: int, family: str,
    unit: str = "unit_id", date: str = "run_date",
) -> DataFrame:
    """(variant, date, gap, lower, upper): the confidence set as a path; NULL before treatment."""
    own = gaps.where(F.col(unit) == treated)
    in_time = Window.partitionBy(VARIANT).orderBy(date)
    post_so_far = F.sum(F.when(F.col("pre") == 0, 1.0).otherwise(0.0)).over(in_time)
    rows = own.withColumn("__k", post_so_far).join(bounds, VARIANT)

    def edge(name: str) -> Column:
        value = {
            "uniform": F.col("gap") + F.col(name),
            "constant": F.col(name),
            "linear": F.col(name) * F.col("__k"),
        }[family]
        return F.when(F.col("pre") == 0, value).alias(name)

    return rows.select(VARIANT, date, "gap", edge("lower"), edge("upper"))
