"""Trading sessions: calendars as tables, made by rule and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_york_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """day, open_utc and close_utc (ms) of regular New York sessions, 9:30 to 16:00, by the exchange's holiday rules since 2022.

    Holidays: New Year, Martin Luther King, Washington, Good Friday, Memorial, Juneteenth, Independence, Labor, Thanksgiving and
    Christmas; on Sundays they move to Monday, on Saturdays to Friday, but not New Year. Sessions end at 13:00 on the day
    after Thanksgiving, on 24 December and on 3 July if these are trading days. One row a day.
    """
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day")
    y, m, dom, dow = F.year("day"), F.month("day"), F.dayofmonth("day"), F.dayofweek("day")  # 1 is Sunday
    nth = F.floor((dom - 1) / 7) + 1
    # Easter Sunday of the Gregorian calendar
    a, b, c = y % 19, F.floor(y / 100), y % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    n = F.floor((a + 11 * h + 22 * k) / 451)
    easter = F.make_date(y, F.floor((h + k - 7 * n + 114) / 31).cast("int"), ((h + k - 7 * n + 114) % 31 + 1).cast("int"))
    fixed = lambda month, d, saturday=True: ((m == month) & (dom == d) & dow.between(2, 6)) | ((m == month) & (dom == d + 1) & (dow == 2)) | ((F.month(F.date_add("day", 1)) == month) & (F.dayofmonth(F.date_add("day", 1)) == d) & (dow == 6) & F.lit(saturday))
    off = fixed(1, 1, False) | fixed(6, 19) | fixed(7, 4) | fixed(12, 25) | ((m == 1) & (dow == 2) & (nth == 3)) | ((m == 2) & (dow == 2) & (nth == 3)) | (F.date_add("day", 2) == easter)
    off = off | ((m == 5) & (dow == 2) & (dom > 24)) | ((m == 9) & (dow == 2) & (nth == 1)) | ((m == 11) & (dow == 5) & (nth == 4))
    short = ((m == 11) & (dow == 6) & (F.dayofmonth(F.date_sub("day", 1)) >= 22) & (F.dayofmonth(F.date_sub("day", 1)) <= 28) & (dom > 22)) | ((m == 12) & (dom == 24)) | ((m == 7) & (dom == 3) & dow.between(2, 5))
    at = lambda clock: F.unix_millis(F.to_utc_timestamp(F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), clock), "America/New_York"))
    return days.where(dow.between(2, 6) & ~off).select("day", at(F.lit("09:30:00")).alias("open_utc"), at(F.when(short, "13:00:00").otherwise("16:00:00")).alias("close_utc"))


def in_session(instants: DataFrame, days: DataFrame) -> DataFrame:
    """instants (ms) with open: whether a session holds the instant, end excluded. Sessions don't overlap, so the day's own decides."""
    own = days.select(F.explode(F.array(F.floor(F.col("open_utc") / 86_400_000), F.floor((F.col("close_utc") - 1) / 86_400_000))).alias("_utc"), "open_utc", "close_utc").distinct()
    rows = instants.withColumn("_utc", F.floor(F.col("ms") / 86_400_000)).join(F.broadcast(own.groupBy("_utc").agg(F.collect_list(F.struct("open_utc", "close_utc")).alias("_s"))), "_utc", "left")  # a row a day of the calendar
    held = F.exists(F.coalesce("_s", F.array().cast("array<struct<open_utc:bigint,close_utc:bigint>>")), lambda s: (F.col("ms") >= s["open_utc"]) & (F.col("ms") < s["close_utc"]))
    return rows.withColumn("open", held).drop("_utc", "_s")


#: Holidays of the Korean calendar by month and day, and the exchange's last day of the year.
KOREAN_DAYS = ("01-01", "03-01", "05-01", "05-05", "06-06", "08-15", "10-03", "12-25", "12-31")


def regular_sessions(spark: SparkSession, calendar: str, first: str, last: str, zone: str, opens: str, closes: str, month_days: tuple[str, ...] = (), holidays: DataFrame | None = None) -> DataFrame:
    """calendar, day, open_utc and close_utc (ms) of the sessions of weekdays from first to last, at the clock of a time zone.

    A session that closes at or before the hour it opens ends the next day. No session begins on month_days (MM-dd) or within
    `span` days of a row of holidays (day, span; null span: 0), such as a table of lunar ones. One row a day.
    """
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day").where("weekday(day) < 5").where(~F.date_format("day", "MM-dd").isin(*month_days, ""))
    if holidays is not None:
        span = F.coalesce("span", F.lit(0))
        off = holidays.where("day is not null").select(F.explode(F.sequence(F.date_sub("day", span), F.date_add("day", span))).alias("day")).distinct()
        days = days.join(off, "day", "left_anti")
    at = lambda day, clock: F.unix_millis(F.to_utc_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(clock)), zone))
    end = F.date_add("day", 1 if closes <= opens else 0)
    return days.select(F.lit(calendar).alias("calendar"), "day", at(F.col("day"), opens).alias("open_utc"), at(end, closes).alias("close_utc"))


def calendar_open(instants: DataFrame, sessions: DataFrame) -> DataFrame:
    """instants (calendar, ms) with open: whether a session of its calendar holds the instant, end excluded.

    Null without a known calendar, without a time, and outside of what the calendar's sessions cover: not verified. Sessions
    may overlap, last over midnight or for days; they meet instants by calendar and UTC day, so no instant meets a calendar's
    whole history and a busy calendar spreads over its days.
    """
    day = lambda ms: F.floor(ms / 86_400_000)
    table = sessions.where("calendar is not null and open_utc < close_utc")
    span = table.groupBy("calendar").agg(F.min("open_utc").alias("_from"), F.max("close_utc").alias("_until"))
    held = table.select("calendar", "open_utc", "close_utc", F.explode(F.sequence(day(F.col("open_utc")), day(F.col("close_utc") - 1))).alias("_day"))
    held = held.groupBy("calendar", "_day").agg(F.collect_list(F.struct("open_utc", "close_utc")).alias("_s"))  # a few sessions a day
    rows = instants.withColumn("_day", day(F.col("ms"))).join(span, "calendar", "left").join(held, ["calendar", "_day"], "left")
    open_ = F.exists("_s", lambda s: (F.col("ms") >= s["open_utc"]) & (F.col("ms") < s["close_utc"]))
    covered = (F.col("ms") >= F.col("_from")) & (F.col("ms") < F.col("_until"))
    return rows.withColumn("open", F.when(covered, F.coalesce(open_, F.lit(False)))).select(*instants.columns, "open")


def commodity_open(instants: DataFrame, days: DataFrame) -> DataFrame:
    """instants with open by the commodity week: Sunday 18:00 to Friday 17:00 New York, a break from 17:00 to 18:00, closed on New York holidays; an evening belongs to the next day's session."""
    local = F.from_utc_timestamp(F.timestamp_millis(F.col("ms")), "America/New_York")
    rows = instants.withColumn("_day", F.to_date(local)).withColumn("_clock", F.hour(local) * 60 + F.minute(local)).withColumn("_dow", F.dayofweek(local)).withColumn("_next", F.date_add("_day", 1))
    held = days.select(F.col("day").alias("_day"), F.lit(True).alias("_has"))
    rows = rows.join(F.broadcast(held), "_day", "left").join(F.broadcast(held.select(F.col("_day").alias("_next"), F.lit(True).alias("_has_next"))), "_next", "left")
    has, following = F.coalesce("_has", F.lit(False)), F.coalesce("_has_next", F.lit(False))
    clock, dow = F.col("_clock"), F.col("_dow")
    value = F.when((dow == 7) | (dow == 1) & (clock < 1080), False).when(dow == 1, following).when(~has, False).when((clock >= 1020) & (clock < 1080), False).when(clock >= 1080, (dow < 6) & following).otherwise(True)
    return rows.withColumn("open", value).drop("_day", "_clock", "_dow", "_next", "_has", "_has_next")


def block_reason(state: Column) -> Column:
    """Why an instrument must not be scanned: closed, or, without a known calendar, unverified."""
    return F.when(state.isNull(), "market_hours_unverified").when(~state, "tradfi_market_closed")


def coverage(symbols: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: mapped and all symbols, and the unmapped ones sorted."""
    rows = symbols.select("symbol").distinct().join(mapped.select("symbol", F.lit(True).alias("_m")).distinct(), "symbol", "left")
    return rows.agg(F.count("_m").alias("mapped"), F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list(F.when(F.col("_m").isNull(), F.col("symbol")))).alias("unmapped"))
