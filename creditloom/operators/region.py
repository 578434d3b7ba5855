"""Study groups, region panels and descriptive tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.functions import credit

NEAR_PRIME = (640, 720)
SUB_PRIME = (None, 640)
HIGH_USE = (0.6, 0.8)


def assign_groups(
    df: DataFrame,
    region: str,
    treated_regions: str,
    province: str,
    control_provinces: Sequence[str],
    distance: str,
    min_km: float = 100.0,
) -> DataFrame:
    """treated by region pattern; control by province and distance from the treated area."""
    # Provinces are searched for: reported values may hold more than the code.
    is_control = F.col(province).rlike("|".join(control_provinces)) & (F.col(distance) >= min_km)
    return df.withColumns(
        {
            "treated": F.when(F.col(region).rlike(treated_regions), 1).otherwise(0),
            "control": F.when(is_control, 1).otherwise(0),
        }
    )


def keep_study_units(df: DataFrame) -> DataFrame:
    return df.where((F.col("treated") == 1) | (F.col("control") == 1))


def group_label(df: DataFrame, region: str, label: str) -> DataFrame:
    """One common region label for everything treated."""
    return df.withColumn(region, F.when(F.col("treated") == 1, label).otherwise(F.col(region)))


class PanelMeasures:
    """Sums, means and distinct consumers per group, all combined before their shuffle.

    Sums and means go straight to the group: what is shuffled is one row per group and task, never
    the wide consumer rows.  Only the distinct counts need the consumer, and take (group, consumer,
    subset flags) alone through two ordinary aggregations; the first spreads a dominant region over
    its consumers.  The two group-sized results are joined.
    """

    def __init__(self, consumer: str):
        self.consumer = consumer
        self._direct: dict[str, Column] = {}
        self._subsets: dict[str, Column | None] = {}
        self._order: list[str] = []

    def distinct(self, name: str, subset: Column | None = None) -> None:
        self._subsets[name] = subset
        self._order.append(name)

    def total(self, name: str, value: Column, subset: Column | None = None, scale=None) -> None:
        total = F.sum(value if subset is None else F.when(subset, value))
        self._direct[name] = total if scale is None else scale(total)
        self._order.append(name)

    def mean(self, name: str, value: Column, subset: Column | None = None) -> None:
        value = value if subset is None else F.when(subset, value)
        self._direct[name] = credit.ratio(F.sum(value), F.count(value))
        self._order.append(name)

    def _distinct_counts(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        flags = {
            f"__{name}": F.when(subset, 1).otherwise(0)
            for name, subset in self._subsets.items()
            if subset is not None
        }
        narrow = df.select(*keys, self.consumer, *[f.alias(n) for n, f in flags.items()])
        if flags:
            per_consumer = narrow.groupBy(*keys, self.consumer).agg(*[F.max(n).alias(n) for n in flags])
        else:
            per_consumer = narrow.distinct()
        who = F.col(self.consumer)
        counts = [
            F.count(who if subset is None else F.when(F.col(f"__{name}") == 1, who)).alias(name)
            for name, subset in self._subsets.items()
        ]
        return per_consumer.groupBy(*keys).agg(*counts)

    def apply(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        direct = [column.alias(name) for name, column in self._direct.items()]
        if not self._subsets:
            return df.groupBy(*keys).agg(*direct)
        counts = self._distinct_counts(df, keys)
        if not direct:
            return counts
        sums, a, b = df.groupBy(*keys).agg(*direct), "__a", "__b"
        # A group may have NULL in its key, so the comparison is null-safe.
        same = [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
        return sums.alias(a).join(counts.alias(b), same).select(
            *[F.col(f"{a}.{k}") for k in keys],
            *[F.col(f"{b if n in self._subsets else a}.{n}") for n in self._order],
        )


def add_score_counts(m: PanelMeasures, score: Column, suffix: str, subset: Column | None) -> None:
    near = credit.in_bin(score, *NEAR_PRIME)
    sub = F.when(score < SUB_PRIME[1], 1).otherwise(0)
    m.total(f"n_nearprime{suffix}", near, subset)
    m.total(f"n_subprime{suffix}", sub, subset)


def add_use_counts(m: PanelMeasures, use: Column, suffix: str, subset: Column | None) -> None:
    m.total(f"n_bc_use_60_80{suffix}", credit.in_bin(use, *HIGH_USE), subset)
    m.total(f"n_bc_use_80_plus{suffix}", credit.in_bin(use, HIGH_USE[1]), subset)


def add_insured_measures(m: PanelMeasures, insured: Column) -> None:
    """Measures over holders of insured mortgages."""
    c = F.col
    use = credit.utilisation(c("bc_bal"), c("bc_lmt"))
    m.distinct("n_ml_ins", insured)
    means = {
        "ml_bal_ins": c("ml_bal_ins"),
        "heloc_bal": c("heloc_bal"),
        "res_bal": c("ml_bal") + c("heloc_bal"),
        "cl_bal": c("other_bal"),
        "bc_bal": c("bc_bal"),
        "bc_bal_arr": c("bc_bal_arr") + c("bc_bal_def"),
        "bc_use": use,
        "cr_score": c("cvsc100"),
    }
    for name, value in means.items():
        m.mean(name, value, insured)
    add_use_counts(m, use, "", insured)
    add_score_counts(m, c("cvsc100"), "", insured)


TOTALS: dict[str, tuple[str, ...]] = {
    "ml_bal_tot": ("ml_bal",),
    "ml_bal_arr_tot": ("ml_bal_arr", "ml_bal_def"),
    "ml_chargoff_new_tot": ("ml_chargoff_new",),
    "ml_bal_ins_tot": ("ml_bal_ins",),
    "ml_bal_arr_ins_tot": ("ml_bal_arr_ins", "ml_bal_def_ins"),
    "ml_chargoff_new_ins_tot": ("ml_chargoff_new_ins",),
    "heloc_bal_tot": ("heloc_bal",),
    "heloc_bal_arr_tot": ("heloc_bal_arr", "heloc_bal_def"),
    "heloc_chargoff_new_tot": ("heloc_chargoff_new",),
    "bc_bal_tot": ("bc_bal",),
    "bc_bal_arr_tot": ("bc_bal_arr", "bc_bal_def"),
    "bc_chargoff_new_tot": ("bc_chargoff_new",),
    "other_bal_tot": ("other_bal",),
    "other_bal_arr_tot": ("other_bal_arr", "other_bal_def"),
    "other_chargoff_new_tot": ("other_chargoff_new",),
}


def add_totals(m: PanelMeasures, totals: Mapping[str, Sequence[str]]) -> None:
    """Region totals in millions, each over the sum of its component columns."""
    for name, parts in totals.items():
        value = F.col(parts[0])
        for part in parts[1:]:
            value = value + F.col(part)
        m.total(name, value, scale=credit.millions)


def add_active_measures(m: PanelMeasures) -> None:
    """Measures over all credit-active consumers."""
    c = F.col
    use = credit.utilisation(c("bc_bal"), c("bc_lmt"))
    m.distinct("n_active")
    m.mean("cr_score_fsa", c("cvsc100"))
    add_score_counts(m, c("cvsc100"), "_fsa", None)
    add_totals(m, TOTALS)
    m.mean("bc_bal_fsa", c("bc_bal"))
    m.mean("bc_use_fsa", use)
    add_use_counts(m, use, "_fsa", None)


def region_panel(
    df: DataFrame,
    consumer: str,
    keys: Sequence[str] = ("run_date", "treated", "fm_damage", "fsa"),
) -> DataFrame:
    """Insured-holder and region-wide measures in one pass; groups without insured holders drop out."""
    insured = (F.col("ml_exist") == 1) & (F.col("ml_bal_ins") > 0)
    m = PanelMeasures(consumer)
    add_insured_measures(m, insured)
    add_active_measures(m)
    m.total("__rows_ins", F.lit(1), insured)
    return m.apply(df, keys).where(F.col("__rows_ins") > 0).drop("__rows_ins")


def eligible_groups(
    df: DataFrame, group: Sequence[str], count: str, minimum: int, treated: str = "treated"
) -> DataFrame:
    """Groups that never fall below the minimum count, plus every treated group."""
    return (
        df.groupBy(*group)
        .agg(F.min(count).alias("__least"), F.min(treated).alias("__treated"))
        .where((F.col("__least") >= minimum) | (F.col("__treated") == 1))
        .select(*group)
    )


def keep_eligible(
    panel: DataFrame, group: Sequence[str], count: str, minimum: int, treated: str = "treated"
) -> DataFrame:
    """Rows of the eligible groups of a region panel, without computing the panel twice.

    A window group is one region's periods, so it is bounded by the calendar.
    """
    per_group = Window.partitionBy(*group)
    least, always = F.min(count).over(per_group), F.min(treated).over(per_group)
    return (
        panel.withColumns({"__least": least, "__treated": always})
        .where((F.col("__least") >= minimum) | (F.col("__treated") == 1))
        .drop("__least", "__treated")
    )


def keep_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of listed groups; the list is small, the rows may be anything."""
    return df.join(groups, list(keys), "left_semi")


def describe_groups(
    df: DataFrame, keys: Sequence[str], unit: str, measures: Mapping[str, Column]
) -> DataFrame:
    """Number of units, and mean and sample standard deviation of each measure, by group."""
    stats = [F.countDistinct(unit).alias("n_fsa")]
    for name, value in measures.items():
        stats += [F.avg(value).alias(f"{name}_avg"), F.stddev_samp(value).alias(f"{name}_sd")]
    return df.groupBy(*keys).agg(*stats)


FACT_MEASURES: dict[str, tuple[str, str | None]] = {
    "n_active": ("n_active", None),
    "ml_bal_ins": ("ml_bal_ins", None),
    "ml_ins_rt": ("ml_bal_ins_tot", "ml_bal_tot"),
    "bc_use": ("bc_use", None),
    "nearprime_rt": ("n_nearprime", "n_ml_ins"),
    "subprime_rt": ("n_subprime", "n_ml_ins"),
}


def fact_table(df: DataFrame, keys: Sequence[str] = ("treated", "fm_damage")) -> DataFrame:
    """The descriptive table of the region panel: levels and ratios."""
    measures = {
        name: F.col(top).cast("double") if bottom is None else credit.ratio(F.col(top), F.col(bottom))
        for name, (top, bottom) in FACT_MEASURES.items()
    }
    return describe_groups(df, keys, "fsa", measures)


def sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
