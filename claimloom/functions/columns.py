"""Column builders: small expressions the operators are composed from.

All of them stay inside built-in Spark expressions, so they take part in
whole-stage code generation, and all of them are written for ANSI mode: a code
is compared as a string and a ratio is a ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def any_match(signals: Mapping[str, Sequence[str | int]]) -> Column:
    """True when any column holds one of its codes; a NULL signal is no match.

    Integer codes compare by number, so '23' and '023' both match 23 and a code
    that is no number matches nothing. Text codes compare as they are, a test
    file scans can use.
    """

    def test(name: str, values: Sequence[str | int]) -> Column:
        if all(isinstance(v, int) for v in values):
            return F.col(name).try_cast("int").isin(*values)
        return F.col(name).isin(*values)

    return reduce(or_, [F.coalesce(test(c, v), F.lit(False)) for c, v in signals.items()])


def ed_visit(
    revenue: str = "REV_CNTR_CD",
    place: str = "POS_CD",
    procedure: str = "LINE_PRCDR_CD",
    revenue_codes: Sequence[str] = codes.ED_REVENUE_CODES,
    place_codes: Sequence[int] = codes.ED_PLACE_CODES,
    procedure_codes: Sequence[str] = codes.ED_PROCEDURE_CODES,
) -> Column:
    """Emergency-department line: a revenue, place or procedure code says so."""
    return any_match({revenue: revenue_codes, place: place_codes, procedure: procedure_codes})


def recode(column: Column | str, labels: Mapping[str, Iterable], default: str | None = codes.MISSING) -> Column:
    """Map code sets to labels. Integer codes also match padded text ('1', '01', '1.0')."""
    source = as_column(column)
    out = None
    for label, values in labels.items():
        values = list(values)
        if all(isinstance(v, int) for v in values):
            hit = source.cast("string").try_cast("double").isin(*[float(v) for v in values])
        else:
            hit = source.cast("string").isin(*values)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def bands(
    column: Column | str,
    limits: Sequence[tuple[str, float]] = codes.AGE_BANDS,
    above: str = codes.OLDEST_BAND,
    default: str = codes.MISSING,
) -> Column:
    """Label a number by the first limit it lies below; NULL gets the default."""
    value = as_column(column)
    out = F.when(value.isNull(), default)
    for label, upper in limits:
        out = out.when(value < upper, label)
    return out.otherwise(above)


def any_all_flag(columns: Sequence[Column | str], yes: str = "yes", no: str = "no", default: str = codes.MISSING) -> Column:
    """'yes' if any flag is 1, 'no' if every flag is 0, else the default."""
    values = [as_column(c) for c in columns]
    return (
        F.when(reduce(or_, [v == 1 for v in values]), yes)
        .when(reduce(and_, [v == 0 for v in values]), no)
        .otherwise(default)
    )


def enrolment_status(days: Column | str) -> Column:
    """Days covered in a month: >0 yes, 0 no, NULL missing."""
    value = as_column(days)
    return F.when(value > 0, "yes").when(value == 0, "no").otherwise(codes.MISSING)


def census_region(state: Column | str, legacy: bool = False) -> Column:
    regions = codes.CENSUS_REGIONS_LEGACY if legacy else codes.CENSUS_REGIONS
    return recode(state, regions, codes.OTHER_REGION)


def all_present(columns: Iterable[str]) -> Column:
    """Every column holds a value. Written as IS NOT NULL tests, which file scans can use."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def present(column: Column | str) -> Column:
    """1 when the column holds a value."""
    return as_column(column).isNotNull().cast("int")


def is_missing(name: str, data_type: str) -> Column:
    """Missing value: NULL, '' or a text holding 'None' or 'NULL'; NaN for floats."""
    value = F.col(name)
    if data_type == "string":
        return value.isNull() | (value == "") | value.contains("None") | value.contains("NULL")
    if data_type in ("double", "float"):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def ratio(top: Column | str, bottom: Column | str, scale: float = 1) -> Column:
    """top / bottom * scale, NULL when the denominator is 0 or NULL."""
    return F.try_divide(as_column(top).cast("double"), as_column(bottom).cast("double")) * F.lit(scale)


def rate_per(count: Column | str, exposure: Column | str, scale: float = 1000, digits: int | None = 1) -> Column:
    value = ratio(count, exposure, scale)
    return value if digits is None else F.round(value, digits)


def share(part: Column | str, whole: Column | str, digits: int | None = 1) -> Column:
    """Percent of a whole; NULL when the whole is 0."""
    return rate_per(part, whole, 100, digits)


def per_member_per_year(amount: Column | str, months: Column | str) -> Column:
    return ratio(amount, months, 12)


def county_key(state_fips: Column | str, county: Column | str) -> Column:
    """Five-character county key; NULL when either part is."""
    return F.concat(as_column(state_fips), as_column(county))


def state_prefix(fips_code: Column | str) -> Column:
    return F.substring(as_column(fips_code), 1, 2)


def total(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def all_above(columns: Iterable[str], limit: float) -> Column:
    """Every measure above the limit; a NULL measure fails."""
    return reduce(and_, [F.coalesce(F.col(c) > limit, F.lit(False)) for c in columns])
