"""Cost of care, the avoidable part of it, and savings.

Amounts keep the type they come in. Decimal input stays decimal through the
sums, so a total does not depend on the order tasks finish in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import ed_visit, per_member_per_year, ratio
from .relational import attach_group_stats, names, whole_levels

CLAIM_GRAIN = ("state", "fips_code", "beneID", "CLM_ID")


def _paid(claim_type: str, wanted: str, amount: str) -> Column:
    """The amount on claims of one type, 0 on the others and where it is missing."""
    return F.coalesce(F.when(F.col(claim_type) == wanted, F.col(amount)), F.lit(0))


def inpatient_cost(
    lines: DataFrame,
    unit: str | Sequence[str],
    claim: Sequence[str] = CLAIM_GRAIN,
    claim_type: str = "CLM_TYPE_CD",
    header_paid: str = "MDCD_PD_AMT",
    line_equivalent: str = "LINE_MDCD_FFS_EQUIV_AMT",
    encounter_rule: str = "mean",
) -> DataFrame:
    """Inpatient cost per unit.

    A fee-for-service claim costs its header payment, which every line repeats,
    so the mean over lines gives it once. An encounter claim costs the mean of
    its lines' equivalent amounts; ``encounter_rule="sum"`` adds them instead.
    """
    combine = {"mean": F.avg, "sum": F.sum}[encounter_rule]
    per_claim = lines.groupBy(*claim).agg(
        F.avg(_paid(claim_type, codes.FEE_FOR_SERVICE, header_paid)).alias("_ffs"),
        combine(_paid(claim_type, codes.ENCOUNTER, line_equivalent)).alias("_mc"),
    )
    return (
        per_claim.groupBy(*names(unit))
        .agg(F.sum("_ffs").alias("ffs_amount_ip"), F.sum("_mc").alias("mc_amount_ip"))
        .withColumn("inpatient_cost", F.col("ffs_amount_ip") + F.col("mc_amount_ip"))
    )


def line_cost(
    lines: DataFrame,
    unit: str | Sequence[str],
    suffix: str = "other",
    claim_type: str = "CLM_TYPE_CD",
    line_paid: str = "LINE_MDCD_PD_AMT",
    line_equivalent: str = "LINE_MDCD_FFS_EQUIV_AMT",
) -> DataFrame:
    """Cost of service lines per unit: line payment or, for encounters, equivalent amount.

    A sum of claim sums is the sum of lines, so one aggregate does both levels.
    """
    ffs, mc = f"ffs_amount_{suffix}", f"mc_amount_{suffix}"
    return (
        lines.groupBy(*names(unit))
        .agg(
            F.sum(_paid(claim_type, codes.FEE_FOR_SERVICE, line_paid)).alias(ffs),
            F.sum(_paid(claim_type, codes.ENCOUNTER, line_equivalent)).alias(mc),
        )
        .withColumn(f"total_cost_{suffix}", F.col(ffs) + F.col(mc))
    )


def ed_cost(lines: DataFrame, unit: str | Sequence[str], detector: Column | None = None, **columns) -> DataFrame:
    """Cost of emergency-department lines per unit."""
    return line_cost(lines.where(ed_visit() if detector is None else detector), unit, "ed", **columns)


def service_costs(
    lines: DataFrame,
    unit: str | Sequence[str],
    detector: Column | None = None,
    claim_type: str = "CLM_TYPE_CD",
    line_paid: str = "LINE_MDCD_PD_AMT",
    line_equivalent: str = "LINE_MDCD_FFS_EQUIV_AMT",
) -> DataFrame:
    """Total and emergency cost of service lines side by side, from one scan.

    Equals ``line_cost`` left-joined to ``ed_cost``: a unit without emergency
    lines has NULL there.
    """
    is_ed = ed_visit() if detector is None else detector
    ffs = _paid(claim_type, codes.FEE_FOR_SERVICE, line_paid)
    mc = _paid(claim_type, codes.ENCOUNTER, line_equivalent)
    sums = lines.groupBy(*names(unit)).agg(
        F.sum(ffs).alias("ffs_amount_other"),
        F.sum(mc).alias("mc_amount_other"),
        F.sum(F.when(is_ed, ffs)).alias("ffs_amount_ed"),
        F.sum(F.when(is_ed, mc)).alias("mc_amount_ed"),
    )
    return sums.withColumns(
        {
            f"total_cost_{s}": F.col(f"ffs_amount_{s}") + F.col(f"mc_amount_{s}")
            for s in ("other", "ed")
        }
    )


def all_costs(
    lines: DataFrame,
    unit: str | Sequence[str],
    stay: Column,
    detector: Column | None = None,
    claim: Sequence[str] = CLAIM_GRAIN,
    claim_type: str = "CLM_TYPE_CD",
    header_paid: str = "MDCD_PD_AMT",
    line_paid: str = "LINE_MDCD_PD_AMT",
    line_equivalent: str = "LINE_MDCD_FFS_EQUIV_AMT",
    stays_only: bool = True,
) -> DataFrame:
    """Inpatient, other and emergency cost per unit in one pass over lines of both kinds.

    ``stay`` tells inpatient lines from service lines. Equals ``inpatient_cost``
    left-joined to ``service_costs``; without ``stays_only``, the full join. The
    grain is mixed: claims for stays, units for service lines.
    """
    stay = F.coalesce(stay, F.lit(False))
    is_ed = ~stay & (ed_visit() if detector is None else detector)
    paid, equivalent = _paid(claim_type, codes.FEE_FOR_SERVICE, line_paid), _paid(claim_type, codes.ENCOUNTER, line_equivalent)
    unit = names(unit)
    # A claim's identity is part of the grouping key of stay lines alone: the
    # mean over a stay's lines needs its claim, while service lines are sums and
    # shrink to one row of a unit on the map side.
    finer = [c for c in claim if c not in unit]
    grain = [F.when(stay, F.col(c)).alias(f"_claim_{c}") for c in finer]
    per_claim = lines.groupBy(*unit, stay.alias("_stay"), *grain).agg(
        F.avg(F.when(stay, _paid(claim_type, codes.FEE_FOR_SERVICE, header_paid))).alias("ffs_amount_ip"),
        F.avg(F.when(stay, equivalent)).alias("mc_amount_ip"),
        F.sum(F.when(~stay, paid)).alias("ffs_amount_other"),
        F.sum(F.when(~stay, equivalent)).alias("mc_amount_other"),
        F.sum(F.when(is_ed, paid)).alias("ffs_amount_ed"),
        F.sum(F.when(is_ed, equivalent)).alias("mc_amount_ed"),
    )
    kinds = {"ip": "inpatient_cost", "other": "total_cost_other", "ed": "total_cost_ed"}
    amounts = [f"{a}_amount_{k}" for k in kinds for a in ("ffs", "mc")]
    out = per_claim.groupBy(*unit).agg(*[F.sum(c).alias(c) for c in amounts], F.max(F.col("_stay").cast("int")).alias("_stays"))
    if stays_only:
        out = out.where(F.col("_stays") == 1)
    return out.drop("_stays").withColumns(
        {total: F.col(f"ffs_amount_{k}") + F.col(f"mc_amount_{k}") for k, total in kinds.items()}
    )


def sum_spend(spend: DataFrame, unit: str | Sequence[str]) -> DataFrame:
    """Coarser units from a cost table at member grain: every amount summed, NULL where no member has one."""
    unit = names(unit)
    amounts = [c for c, t in spend.dtypes if t == "double" or t.startswith("decimal")]
    return spend.groupBy(*unit).agg(*[F.sum(c).alias(c) for c in amounts])


def combine_costs(base: DataFrame, others: Sequence[DataFrame], unit: str | Sequence[str], how: str = "left") -> DataFrame:
    """Costs side by side per unit.

    Units come from the first table; ``how="full"`` keeps those of any.
    """
    out = base
    for other in others:
        out = out.join(other, names(unit), how)
    return out


def avoidable_cost(costs: DataFrame, fill: float | None = None) -> DataFrame:
    """Avoidable part of the ED and inpatient cost present, and their sum.

    The sum is NULL where either part is; ``fill`` stands in for a missing part.
    """
    parts = {}
    if "total_cost_ed" in costs.columns:
        parts["avoid_ed_cost"] = ("total_cost_ed", "ed_percent")
    if "inpatient_cost" in costs.columns:
        parts["avoid_ip_cost"] = ("inpatient_cost", "ip_percent")
    out = costs.withColumns(
        {
            name: F.col(cost).cast("double") * F.col(percent) / 100
            for name, (cost, percent) in parts.items()
        }
    )
    if len(parts) == 2:
        ed, ip = F.col("avoid_ed_cost"), F.col("avoid_ip_cost")
        if fill is not None:
            ed, ip = F.coalesce(ed, F.lit(fill)), F.coalesce(ip, F.lit(fill))
        out = out.withColumn("avoid_acute_cost", ed + ip)
    return out


def with_pmpy(df: DataFrame, costs: Mapping[str, str], months: str = "member_month") -> DataFrame:
    """Per member per year: ``costs`` maps output column to cost column."""
    return df.withColumns({out: per_member_per_year(cost, months) for out, cost in costs.items()})


def pmpy_total(df: DataFrame, cost: str, months: str = "member_month") -> DataFrame:
    """All units together: cost, months, cost per member per year."""
    total = df.agg(F.sum(cost).alias(cost), F.sum(months).alias(months))
    return with_pmpy(total, {"pmpy": cost}, months)


def unit_costs(costs: DataFrame, percents: DataFrame, unit: str | Sequence[str], pmpy: Mapping[str, str], fill: float | None = None) -> DataFrame:
    """Costs joined to their unit's months and shares, with avoidable cost and PMPY."""
    return with_pmpy(avoidable_cost(costs.join(percents, names(unit), "left"), fill), pmpy)


def member_costs(
    members: DataFrame,
    costs: Sequence[tuple[DataFrame, Sequence[str]]],
    percents: DataFrame,
    pmpy: Mapping[str, str],
    keys: Sequence[str] = ("beneID", "state"),
    unit: str = "fips_code",
    months: str = "member_month",
) -> DataFrame:
    """Every cohort member's cost, zero for those without claims, and its avoidable part.

    ``costs`` pairs a member-level cost table with the columns taken from it.
    Shares and months are the county's; pass another ``months`` column of the
    members to divide by their own.
    """
    out = members
    for table, columns in costs:
        out = out.join(table.select(*keys, *columns), list(keys), "left")
    out = out.fillna(0, subset=[c for _, columns in costs for c in columns])
    return with_pmpy(avoidable_cost(out.join(percents, unit, "left")), pmpy, months)


SAVINGS = {"saving_ed": "pmpy_ed", "saving_ip": "pmpy_ip"}


def savings_to_median(
    units: DataFrame,
    by: str = "state",
    savings: Mapping[str, str] = SAVINGS,
    months: str = "member_month",
    accuracy: int = 10_000,
) -> DataFrame:
    """Cost saved if units above their group's median came down to it."""
    medians = {
        f"{pmpy}_med": F.percentile_approx(pmpy, 0.5, accuracy) for pmpy in savings.values()
    }
    out = attach_group_stats(units, by, medians)
    return out.withColumns(
        {
            name: F.when(
                F.col(pmpy) > F.col(f"{pmpy}_med"),
                (F.col(pmpy) - F.col(f"{pmpy}_med")) * F.lit(1 / 12) * F.col(months),
            ).otherwise(0.0)
            for name, pmpy in savings.items()
        }
    )


def savings_summary(units: DataFrame, by: str | Sequence[str] = (), months: str = "member_month", with_total: bool = False) -> DataFrame:
    """Savings per group, in total and per member per year.

    ``with_total`` adds the overall row (group columns NULL), and ``is_total``
    tells it from a group of NULLs.
    """
    by = names(by)
    groups = units.rollup(*by) if with_total else units.groupBy(*by)
    out = groups.agg(
        F.sum("saving_ed").alias("saving_ed"),
        F.sum("saving_ip").alias("saving_ip"),
        F.sum(months).alias("months"),
        *([F.grouping_id().alias("_level")] if with_total else []),
    )
    if with_total:
        out = whole_levels(out, by)
    both = F.col("saving_ed") + F.col("saving_ip")
    return out.withColumns(
        {
            "pmpy_ip_saving": ratio("saving_ip", "months", 12),
            "pmpy_ed_saving": ratio("saving_ed", "months", 12),
            "saving_total": both,
            "pmpy_total_saving": ratio(both, F.col("months"), 12),
        }
    )
