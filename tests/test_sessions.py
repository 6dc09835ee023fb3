"""Session tables against a plain look at every session."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from tidemark.operators import sessions


def ms(day, clock, zone):
    return int(dt.datetime.combine(day, dt.time.fromisoformat(clock), ZoneInfo(zone)).timestamp() * 1000)


def test_sessions_of_any_zone(spark):
    lunar = spark.createDataFrame([(dt.date(2024, 2, 10), 1), (dt.date(2024, 5, 15), None), (None, 3)], "day date, span int")
    cases = {"KRX": ("Asia/Seoul", "09:00:00", "15:30:00", sessions.KOREAN_DAYS), "NIGHT": ("Asia/Seoul", "18:00:00", "05:00:00", ()), "LONDON": ("Europe/London", "08:00:00", "16:30:00", ("12-25",))}
    table, plain = None, []
    for name, (zone, opens, closes, off) in cases.items():
        own = sessions.regular_sessions(spark, name, "2024-01-01", "2024-12-31", zone, opens, closes, off, lunar if name == "KRX" else None)
        table = own if table is None else table.unionByName(own)
        for n in range(366):
            day = dt.date(2024, 1, 1) + dt.timedelta(n)
            closed = name == "KRX" and day in {dt.date(2024, 2, 9), dt.date(2024, 2, 10), dt.date(2024, 2, 11), dt.date(2024, 5, 15)}
            if day.weekday() < 5 and f"{day:%m-%d}" not in off and not closed:
                plain.append((name, ms(day, opens, zone), ms(day + dt.timedelta(closes <= opens), closes, zone)))
    assert sorted((r["calendar"], r["open_utc"], r["close_utc"]) for r in table.collect()) == sorted(plain)

    dice = random.Random(2)
    marks = [m + e for _, a, z in dice.sample(plain, 60) for m in (a, z) for e in (-1, 0, 1)] + [dice.randrange(1_703_900_000_000, 1_735_800_000_000) for _ in range(400)]
    rows = [(n, m, "x") for n in (*cases, "NONE", None) for m in marks] + [("KRX", None, "x")]
    found = sessions.calendar_open(spark.createDataFrame(rows, "calendar string, ms bigint, open_utc string"), table)
    span = {n: (min(a for k, a, _ in plain if k == n), max(z for k, _, z in plain if k == n)) for n in cases}
    want = lambda n, m: None if n not in span or m is None or not span[n][0] <= m < span[n][1] else any(k == n and a <= m < z for k, a, z in plain)
    got = sorted(((r["calendar"], r["ms"], r["open"]) for r in found.collect()), key=str)
    assert got == sorted(((n, m, want(n, m)) for n, m, _ in rows), key=str)
    assert {x for *_, x in got} == {True, False, None}
    assert sessions.calendar_open(found.drop("open").limit(0), table).count() == 0
