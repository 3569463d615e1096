"""Claim assembly and field completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import all_present, flag, present
from ..sources.writers import save_buckets
from .relational import whole_levels

CLAIM_KEYS = ("BENE_ID", "STATE_CD", "CLM_ID")


def assemble_claims(
    lines: DataFrame,
    headers: DataFrame,
    keys: Sequence[str] = CLAIM_KEYS,
    claim_type: str = "CLM_TYPE_CD",
    types: Sequence[str] = codes.CLAIM_TYPES,
    month: str | None = None,
) -> DataFrame:
    """Claim lines joined to the headers of the wanted claim types, at line grain.

    A dataset of several months passes its month column: it becomes one more
    join key, so a claim number used again in another month does not match.
    """
    keys = [*keys, *([month] if month else [])]
    wanted = headers.where(F.col(claim_type).isin(*types) & all_present(keys))
    return lines.where(all_present(keys)).join(wanted, keys, "inner")


def bucketed_claims(
    lines: DataFrame,
    headers: DataFrame,
    name: str,
    buckets: int,
    keys: Sequence[str] = CLAIM_KEYS,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Lines and headers stored side by side for assembly: both in the same buckets of the claim keys.

    Assembling, collapsing to claims and counting completeness then start from
    the files without moving a row, as often as they are run. Rows without all
    keys take part in none of these and are left out, which also keeps them from
    filling one bucket; what is left spreads by claim, of bounded size each.
    """
    stored = []
    for part, df in (("line", lines), ("header", headers)):
        path = f"{folder}/{part}" if folder else None
        stored.append(save_buckets(df.where(all_present(keys)), f"{name}_{part}", keys, buckets, path))
    return stored[0], stored[1]


def presence_flags(lines: DataFrame, fields: Mapping[str, str], any_of: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """0/1 columns saying which fields hold a value, and which groups hold any."""
    flagged = lines.withColumns({name: present(column) for name, column in fields.items()})
    groups = {
        name: F.greatest(*[F.col(f) for f in flags]) if len(flags) > 1 else F.col(flags[0])
        for name, flags in any_of.items()
    }
    return flagged.withColumns(groups) if groups else flagged


def claim_flags(lines: DataFrame, flags: Sequence[str], keys: Sequence[str] = CLAIM_KEYS) -> DataFrame:
    """A claim has a field when any of its lines has it."""
    return lines.groupBy(*keys).agg(*[F.max(f).alias(f) for f in flags])


def completeness(
    lines: DataFrame,
    fields: Mapping[str, str],
    checks: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    keys: Sequence[str] = CLAIM_KEYS,
    any_of: Mapping[str, Sequence[str]] = {},
    with_total: bool = False,
) -> DataFrame:
    """Number of claims passing each check, per group or overall.

    Without ``checks`` every presence flag is counted. ``with_total`` adds the
    overall row (group columns NULL) in the same pass, and ``is_total`` tells it
    from a group of NULLs.
    """
    names = [*fields, *any_of]
    claims = claim_flags(presence_flags(lines, fields, any_of), names, keys)
    if checks is None:
        counted = names
    else:
        claims = claims.withColumns({name: flag(condition) for name, condition in checks.items()})
        counted = list(checks)
    groups = claims.rollup(*by) if with_total else claims.groupBy(*by)
    out = groups.agg(
        *[F.sum(c).alias(c) for c in counted], F.count(F.lit(1)).alias("totalClaims"),
        *([F.grouping_id().alias("_level")] if with_total else []),
    )
    if with_total:
        out = whole_levels(out, by)
    return out


# Fields checked for inpatient and other-services claims.
INPATIENT_FIELDS = {
    "procNotNull": "PRCDR_CD_1",
    "diagNotNull": "DGNS_CD_1",
    "npiNotNull": "SRVC_PRVDR_NPI",
    "specCodeNotNull": "SRVC_PRVDR_SPCLTY_CD",
    "drgNotNull": "DRG_CD",
    "startDateNotNull": "SRVC_BGN_DT",
    "endDateNotNull": "SRVC_END_DT",
    "billNpiNotNull": "BLG_PRVDR_NPI",
    "billNpiSpecNotNull": "BLG_PRVDR_SPCLTY_CD",
}
INPATIENT_PAYMENTS = {
    "linePaidNotNull": "LINE_MDCD_PD_AMT",
    "lineFfsEquivAmountNN": "LINE_MDCD_FFS_EQUIV_AMT",
    "headBilledNotNull": "BILLED_AMT",
    "headMdcrNotNull": "MDCR_PD_AMT",
    "headMdcdNotNull": "MDCD_PD_AMT",
    "headBeneNotNull": "MDCD_COPAY_AMT",
}
INPATIENT_ANY_PAYMENT = {
    "headTotPaidNotNull": ("headMdcrNotNull", "headMdcdNotNull", "headBeneNotNull")
}
OTHER_FIELDS = {
    "procNotNull": "LINE_PRCDR_CD",
    "diagNotNull": "DGNS_CD_1",
    "npiNotNull": "SRVC_PRVDR_NPI",
    "specCodeNotNull": "SRVC_PRVDR_SPCLTY_CD",
    "billNpiNotNull": "BLG_PRVDR_NPI",
    "billNpiSpecNotNull": "BLG_PRVDR_SPCLTY_CD",
}
OTHER_PAYMENTS = {
    "LineBeneCopayNotNull": "LINE_COPAY_AMT",
    "LineMdcrPaidNotNull": "LINE_MDCR_PD_AMT",
    "LineMdcdPaidNotNull": "LINE_MDCD_PD_AMT",
}
OTHER_ANY_PAYMENT = {
    "LinePaidNotNull": ("LineBeneCopayNotNull", "LineMdcrPaidNotNull", "LineMdcdPaidNotNull")
}


def _has(*flags: str) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & (F.col(f) == 1)
    return out


def _provider() -> Column:
    names = ("npiNotNull", "specCodeNotNull", "billNpiNotNull", "billNpiSpecNotNull")
    return F.greatest(*[F.col(n) for n in names]) == 1


def inpatient_checks() -> dict[str, Column]:
    """Complete claims, and complete but for procedure, or procedure and DRG."""
    dated = _has("startDateNotNull", "endDateNotNull", "diagNotNull") & _provider()
    return {
        "all": dated & _has("procNotNull", "drgNotNull"),
        "noProc": dated & _has("drgNotNull"),
        "noProcDrg": dated,
    }


def other_checks() -> dict[str, Column]:
    return {"noMissing": _has("procNotNull", "diagNotNull") & _provider()}
