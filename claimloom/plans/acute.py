"""The acute-care chain: claims to events, episodes, classes, counties and rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_match, ed_visit, flag
from ..operators import classify, episodes, geography, rates

EVENT_COLUMNS = ("beneID", "state", "CLM_ID", "StartDate", "EndDate", "DGNS_CD_1", "EDvisit", "inpatientVisit")


@dataclass(frozen=True)
class EpisodeRule:
    """How events link: gap in days, and the end they are compared with."""

    gap_days: int = 1
    rule: str = "previous"


def acute_events(
    inpatient: DataFrame,
    other: DataFrame,
    start: str = "SRVC_BGN_DT",
    end: str = "SRVC_END_DT",
    signals: Mapping[str, Sequence[str]] | None = None,
    columns: Sequence[str] = EVENT_COLUMNS,
) -> DataFrame:
    """Inpatient lines and emergency lines as one stream of dated events."""
    is_ed = any_match(signals) if signals else ed_visit()
    dated = {"StartDate": F.col(start).cast("date"), "EndDate": F.col(end).cast("date")}
    stays = inpatient.withColumns(dated | {"EDvisit": F.lit(0), "inpatientVisit": F.lit(1)})
    visits = other.where(is_ed).withColumns(dated | {"EDvisit": F.lit(1), "inpatientVisit": F.lit(0)})
    return stays.select(*columns).unionByName(visits.select(*columns))


def acute_events_in_one_pass(
    lines: DataFrame,
    is_stay: Column,
    is_visit: Column,
    start: str = "SRVC_BGN_DT",
    end: str = "SRVC_END_DT",
    columns: Sequence[str] = EVENT_COLUMNS,
) -> DataFrame:
    """The same events from one dataset holding both kinds of line, read once."""
    stay = F.coalesce(is_stay, F.lit(False))
    return (
        lines.where(stay | is_visit)
        .withColumns(
            {
                "StartDate": F.col(start).cast("date"),
                "EndDate": F.col(end).cast("date"),
                "EDvisit": flag(~stay),
                "inpatientVisit": flag(stay),
            }
        )
        .select(*columns)
    )


def classified_visits(events: DataFrame, ed_flags: DataFrame, ip_codes: DataFrame, code: str = "DGNS_CD_1") -> DataFrame:
    """Events with the lookup flags and the six visit flags.

    ed_flags: (code, avoidableEdVisit), one row per code; ip_codes: (code).
    """
    scored = classify.lookup_flag(events, ed_flags, code, "avoidableEdVisit")
    listed = classify.lookup_member(scored, ip_codes, code, "avoidableIpVisit")
    return classify.visit_flags(listed)


def acute_episodes(
    visits: DataFrame,
    members: DataFrame | None = None,
    carry: Sequence[str] = (),
    keys: Sequence[str] = ("beneID", "state"),
    maxima: Sequence[str] = (*classify.VISIT_FLAGS, "DGNS_CD_1"),
    how: EpisodeRule = EpisodeRule(),
) -> DataFrame:
    """One classified row per episode, with member columns when members are given."""
    collapsed = episodes.collapse_episodes(
        visits, maxima, keys, gap_days=how.gap_days, rule=how.rule, members=members, carry=carry
    )
    return classify.hierarchy(classify.inpatient_over_ed(collapsed))


def county_file(members: DataFrame, classified: DataFrame, unit: str | Sequence[str] = "fips_code") -> DataFrame:
    return geography.roll_up(members, classified, unit)


def utilisation_by(counties: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    return rates.utilisation(counties, by)
