"""Member-month enrolment panel and member demographics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import all_present, any_all_flag, bands, county_key, enrolment_status, recode
from .relational import one_row_per


@dataclass(frozen=True)
class MonthFamily:
    """Twelve monthly columns ``{prefix}_01 .. {prefix}_12`` and how duplicates combine."""

    prefix: str
    how: str  # "sum" or "max"


# The monthly families of the eligibility file.
ENROLMENT_FAMILIES = {
    "medicaidDays": MonthFamily("MDCD_ENRLMT_DAYS", "sum"),
    "chipDays": MonthFamily("CHIP_ENRLMT_DAYS", "sum"),
    "mcPlanType": MonthFamily("MC_PLAN_TYPE_CD", "max"),
    "chipCode": MonthFamily("CHIP_CD", "max"),
    "dualStatus": MonthFamily("DUAL_ELGBL_CD", "max"),
}


def monthly_panel(
    wide: DataFrame,
    keys: Mapping[str, str],
    families: Mapping[str, MonthFamily] = ENROLMENT_FAMILIES,
    months: Sequence[int] = tuple(range(1, 13)),
    month: str = "month",
) -> DataFrame:
    """Wide monthly columns to one row per key and month, NULL months kept.

    ``keys`` maps source key columns to output names. Duplicate source rows of
    a key combine first, then one ``stack`` turns every family long at once:
    one scan, one shuffle, no joins.
    """
    combine = {"sum": F.sum, "max": F.max}
    aggregates = [
        combine[family.how](f"{family.prefix}_{m:02d}").alias(f"{name}_{m}")
        for name, family in families.items()
        for m in months
    ]
    flat = (
        wide.where(all_present(keys))
        .groupBy(*[F.col(source).alias(out) for source, out in keys.items()])
        .agg(*aggregates)
    )
    cells = [
        cell for m in months for cell in (F.lit(str(m)), *[F.col(f"{name}_{m}") for name in families])
    ]
    return flat.select(
        *keys.values(), F.stack(F.lit(len(months)), *cells).alias(month, *families)
    )


def one_measure_panel(wide: DataFrame, keys: Sequence[str], columns: Mapping[str, str], month: str, value: str) -> DataFrame:
    """A single family wide to long: ``columns`` maps source column to month label."""
    renamed = wide.select(*keys, *[F.col(c).alias(label) for c, label in columns.items()])
    return renamed.unpivot(list(keys), list(columns.values()), month, value)


def enrolment_labels(panel: DataFrame, count_chip: bool = False) -> DataFrame:
    """Enrolment, dual, managed-care and coverage labels of a member-month.

    ``enrolled`` looks at Medicaid days only; ``count_chip`` lets CHIP days count too.
    """
    covered = F.col("medEnroll") == "yes"
    if count_chip:
        covered = covered | (F.col("chipEnroll") == "yes")
    return panel.withColumns(
        {
            "medEnroll": enrolment_status("medicaidDays"),
            "chipEnroll": enrolment_status("chipDays"),
            "dual": recode("dualStatus", {"no": codes.NOT_DUAL_CODES, "yes": codes.DUAL_CODES}),
            "managedCare": recode("mcPlanType", {"yes": codes.MANAGED_CARE_CODES}, "no"),
            "coverageType": recode("chipCode", codes.COVERAGE_CODES),
        }
    ).withColumn("enrolled", F.when(covered, "yes").otherwise("no"))


def covered_months(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("enrolled") != "no")


def demographics(raw: DataFrame) -> DataFrame:
    """Recoded demographics, one output row per input row, county key included."""
    recoded = {
        name: recode(source, labels)
        for name, (source, labels) in codes.DEMOGRAPHIC_RECODES.items()
    }
    out = {
        "beneID": F.col("BENE_ID"),
        "state": F.col("STATE_CD"),
        "stateFips": F.col("BENE_STATE_CD"),
        "countyFips": F.col("BENE_CNTY_CD"),
        "county": county_key("BENE_STATE_CD", "BENE_CNTY_CD"),
        "zipCode": F.col("BENE_ZIP_CD"),
        "age": F.col("AGE"),
        "ageCat": bands("AGE"),
        **recoded,
        "disabled": any_all_flag(codes.DISABILITY_FLAGS),
    }
    return raw.where(all_present(["BENE_ID", "STATE_CD"])).select(*[c.alias(n) for n, c in out.items()])


def member_demographics(recoded: DataFrame) -> DataFrame:
    """One row per member and state."""
    return one_row_per(recoded.drop("stateFips", "countyFips"), ["beneID", "state"])


def attach_demographics(panel: DataFrame, demo: DataFrame, keys: Sequence[str] = ("beneID", "state"), matched: str | None = None) -> DataFrame:
    """Left join of member attributes; ``matched`` names a 0/1 column saying which rows found one."""
    if matched is None:
        return panel.join(demo, list(keys), "left")
    out = panel.join(demo.withColumn(matched, F.lit(1)), list(keys), "left")
    return out.fillna(0, subset=[matched])


def member_months(panel: DataFrame, keys: Sequence[str] = ("beneID", "state")) -> DataFrame:
    """Months with dual eligibility and months with Medicaid coverage per member."""
    return panel.groupBy(*keys).agg(
        F.count_if(F.col("dual") == "yes").alias("medicareMonths"),
        F.count_if(F.col("medEnroll") == "yes").alias("medicaidMonths"),
    )
