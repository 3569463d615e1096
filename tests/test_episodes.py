"""Episode linking: edge rows, a row-by-row model, and groups of very unequal size."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import episodes

DAY = timedelta(days=1)
EDGE = [
    ("2024-01-01", "2024-01-30", 1, 1, "1.First"),
    ("2024-01-05", "2024-01-06", 1, 1, "6.Embedded"),
    ("2024-01-10", "2024-01-12", 2, 1, "2.New Episode"),
    ("2024-01-13", "2024-01-13", 2, 1, "3.Regular Overlap"),
    ("2024-01-13", "2024-01-13", 2, 1, "7.Perfect Overlap"),
    ("2024-01-20", "2024-01-25", 3, 1, "2.New Episode"),
    ("2024-01-22", "2024-01-25", 3, 1, None),
]


def model(events, gap=1, rule="previous"):
    """(member, start, end, payload) -> the same with episode and label, one row at a time."""
    out = []
    by_member = defaultdict(list)
    for e in events:
        by_member[e[0]].append(e)
    early = date.min
    for member, own in by_member.items():
        own.sort(key=lambda e: (e[1] is not None, e[1] or early, e[2] is not None, e[2] or early, e[3]))
        episode, prev_start, prev_end, latest = 0, None, None, None
        for i, (_, start, end, payload) in enumerate(own):
            known = prev_end if rule == "previous" else latest
            new = known is None or (start is not None and start > known + gap * DAY)
            episode += new
            if i == 0:
                label = "1.First"
            elif new:
                label = "2.New Episode"
            elif start is None or end is None or prev_start is None:
                label = None
                if start is not None and end is not None and start <= known + gap * DAY and end > known:
                    label = "3.Regular Overlap"
            elif start <= known + gap * DAY and end > known:
                label = "3.Regular Overlap"
            elif start == prev_start and end < known:
                label = "5.Same Start Date (SRO)"
            elif start > prev_start and end < known:
                label = "6.Embedded"
            elif start == prev_start and end == known:
                label = "7.Perfect Overlap"
            else:
                label = None
            out.append((member, start, end, payload, episode, label))
            prev_start, prev_end = start, end
            if end is not None:
                latest = end if latest is None else max(latest, end)
    return out


def collapsed_model(numbered):
    groups = defaultdict(list)
    for member, start, end, payload, episode, _ in numbered:
        groups[member, episode].append((start, end, payload))
    smallest = lambda v: min((x for x in v if x is not None), default=None)
    largest = lambda v: max((x for x in v if x is not None), default=None)
    return Counter(
        (m, n, largest([g[2] for g in own]), smallest([g[0] for g in own]), largest([g[1] for g in own]))
        for (m, n), own in groups.items()
    )


def frame(spark, events):
    return spark.createDataFrame(events, "beneID long, StartDate date, EndDate date, f int")


def some_events(seed, members=6, size=60, missing=0.1, reversed_share=0.1):
    rng = random.Random(seed)
    first = date(2024, 1, 1)
    out = []
    for _ in range(size):
        start = first + rng.randrange(60) * DAY
        end = start + rng.randrange(8) * DAY
        if rng.random() < reversed_share:
            end = start - rng.randrange(1, 5) * DAY
        if rng.random() < missing:
            end = None
        if rng.random() < missing / 3:
            start = None
        out.append((rng.randrange(members), start, end, rng.randrange(2)))
    return out + rng.choices(out, k=size // 3)


@pytest.mark.parametrize("rule,column", [("previous", 2), ("running_max", 3)])
def test_edge_rows(rows, rule, column):
    df = rows([(1, e[0], e[1]) for e in EDGE], "beneID long, StartDate date, EndDate date")
    out = episodes.number_episodes(df, ["beneID"], rule=rule).collect()
    got = Counter((str(r.StartDate), str(r.EndDate), r.episode) for r in out)
    assert got == Counter((e[0], e[1], e[column]) for e in EDGE)
    if rule == "previous":
        labels = Counter((str(r.StartDate), str(r.EndDate), r.ovlp) for r in out)
        assert labels == Counter((e[0], e[1], e[4]) for e in EDGE)


def test_event_after_unknown_end_starts_an_episode(rows):
    df = rows(
        [(1, "2024-01-01", None), (1, "2024-01-01", "2024-01-02")],
        "beneID long, StartDate date, EndDate date",
    )
    assert sorted(r.episode for r in episodes.number_episodes(df, ["beneID"]).collect()) == [1, 2]


@pytest.mark.parametrize("rule", ["previous", "running_max"])
@pytest.mark.parametrize("gap", [0, 1, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_model(spark, seed, gap, rule):
    events = some_events(seed)
    numbered = model(events, gap, rule)
    df = frame(spark, events)
    out = episodes.number_episodes(df, ["beneID"], gap_days=gap, rule=rule)
    got = Counter((r.beneID, r.StartDate, r.EndDate, r.episode, r.ovlp) for r in out.collect())
    assert got == Counter((m, s, e, n, label) for m, s, e, _, n, label in numbered)
    rows_kept = Counter((r.beneID, r.StartDate, r.EndDate, r.f) for r in out.collect())
    assert rows_kept == Counter(events)

    quick = episodes.number_episodes(df, ["beneID"], gap_days=gap, rule=rule, few_copies=True)
    assert Counter((r.beneID, r.StartDate, r.EndDate, r.episode, r.ovlp) for r in quick.collect()) == got

    for few in (False, True):
        by_days = episodes.number_episodes(df, ["beneID"], gap_days=gap, rule=rule, overlap=None, few_copies=few).collect()
        assert Counter(tuple(r)[:3] + (r.episode,) for r in by_days) == Counter((m, s, e, n) for m, s, e, _, n, _ in numbered)
        assert Counter((r.beneID, r.StartDate, r.EndDate, r.f) for r in by_days) == Counter(events)

    whole = episodes.collapse_episodes(df, ["f"], ["beneID"], gap_days=gap, rule=rule)
    got = Counter((r.beneID, r.episode, r.f, r.StartDate, r.EndDate) for r in whole.collect())
    # Among copies that stand alone any may carry any number: compare without it.
    drop_number = lambda c: Counter(k[:1] + k[2:] for k in c.elements())
    assert drop_number(got) == drop_number(collapsed_model(numbered))
    assert Counter((k[0], k[1]) for k in got) == Counter({(m, n): 1 for m, *_, n, _ in numbered})


@pytest.mark.parametrize("rule", ["previous", "running_max"])
def test_diagnosis_and_flag_maxima_against_model(spark, rule):
    """Codes and numbers are combined in different places; together they must give plain maxima."""
    events = [(m, s, e, ("abcd"[i % 4], f)) for i, (m, s, e, f) in enumerate(some_events(8))]
    numbered = model(events, rule=rule)
    df = spark.createDataFrame(
        [(m, s, e, dx, f) for m, s, e, (dx, f) in events], "beneID long, StartDate date, EndDate date, dx string, f int"
    )
    groups = defaultdict(list)
    for member, start, end, (dx, f), episode, _ in numbered:
        groups[member, episode].append((start, end, dx, f))
    expected = Counter(
        (
            m, max(g[2] for g in own), max(g[3] for g in own),
            min((g[0] for g in own if g[0]), default=None), max((g[1] for g in own if g[1]), default=None),
        )
        for (m, _), own in groups.items()
    )
    out = episodes.collapse_episodes(df, ["f", "dx"], ["beneID"], rule=rule).collect()
    assert Counter((r.beneID, r.dx, r.f, r.StartDate, r.EndDate) for r in out) == expected
    assert len({(r.beneID, r.episode) for r in out}) == len(out)


def test_two_keys_and_member_columns(spark):
    events = some_events(3)
    df = frame(spark, events).withColumn("state", F.when(F.col("f") == 1, "ME").otherwise("VA"))
    members = df.select("beneID", "state").distinct().withColumn("fips_code", F.concat("state", "beneID"))
    members = members.where(F.col("beneID") > 0)
    out = episodes.collapse_episodes(df, ["f"], members=members, carry=["fips_code"]).collect()
    expected = model([((m, p), s, e, p) for m, s, e, p in events if m > 0])
    assert len(out) == len({(r[0], r[4]) for r in expected})
    assert all(r.fips_code == f"{r.state}{r.beneID}" for r in out)


def test_one_member_and_one_interval_hold_most_rows(spark, monkeypatch):
    """A third of all rows are copies of one event, another third belong to one member."""
    monkeypatch.setattr(episodes, "COPIES_PER_CHUNK", 7)
    monkeypatch.setattr(episodes, "INTERVAL_SLICES", 5)
    first = date(2024, 3, 1)
    hot = [(1, first, first + DAY, 0)] * 300 + [(1, first, None, i % 2) for i in range(100)]
    member = [(1, first + (i % 90) * DAY, first + (i % 90 + i % 4) * DAY, i % 2) for i in range(300)]
    events = hot + member + some_events(9, size=200)
    numbered = model(events)
    df = frame(spark, events)
    out = episodes.number_episodes(df, ["beneID"]).collect()
    assert Counter((r.beneID, r.StartDate, r.EndDate, r.episode, r.ovlp) for r in out) == Counter(
        (m, s, e, n, label) for m, s, e, _, n, label in numbered
    )
    by_days = episodes.number_episodes(df, ["beneID"], overlap=None).collect()
    assert Counter((r.beneID, r.StartDate, r.EndDate, r.episode) for r in by_days) == Counter(
        (m, s, e, n) for m, s, e, _, n, _ in numbered
    )
    whole = episodes.collapse_episodes(df, ["f"], ["beneID"]).collect()
    drop_number = lambda c: Counter(k[:1] + k[2:] for k in c.elements())
    got = Counter((r.beneID, r.episode, r.f, r.StartDate, r.EndDate) for r in whole)
    assert drop_number(got) == drop_number(collapsed_model(numbered))
    assert len(got) == len(whole)


def test_numbers_are_dense_from_one(spark):
    out = episodes.collapse_episodes(frame(spark, some_events(4)), ["f"], ["beneID"])
    spans = out.groupBy("beneID").agg(
        F.min("episode").alias("low"), F.max("episode").alias("high"), F.count("*").alias("n")
    )
    assert spans.where((F.col("low") != 1) | (F.col("high") != F.col("n"))).count() == 0


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        episodes.collapse_episodes(frame(spark, some_events(5)), ["f"], ["beneID"], rule="latest")
