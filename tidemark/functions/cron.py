"""Cron expressions as sets of minutes, hours, days and months, and when they fire, without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Least and most value of each field: minute, hour, day of month, month, day of week (0 and 7 are Sunday).
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
#: Names of days, from Sunday as 0, and of months, from January as 1.
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _number(text: Column, names: tuple[str, ...], first: int) -> Column:
    low = F.lower(F.trim(text))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), low) if names else F.lit(0)
    return F.when(place > 0, place.cast("int") - 1 + first).otherwise(low.try_cast("int"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def field_set(text: Column, least: int, most: int, names: tuple[str, ...] = (), first: int = 0) -> Column:
    """The values of one field: lists of ``*``, ``a``, ``a-b``, each with ``/step``; an empty array if the field is wrong.

    ``a/step`` goes on to the end of the field. Numbers and names both count from the field's least value."""

    def bounds(pieces: Column) -> Column:
        step = F.when(F.size(pieces) == 1, F.lit(1)).when(F.size(pieces) == 2, F.get(pieces, F.lit(1)).try_cast("int"))
        return _let(F.split(F.get(pieces, F.lit(0)), "-"), lambda span: F.struct(
            step.alias("step"), (F.get(pieces, F.lit(0)) == "*").alias("star"), F.size(pieces).alias("pieces"), F.size(span).alias("ends"),
            _number(F.get(span, F.lit(0)), names, first).alias("low"), _number(F.get(span, F.lit(1)), names, first).alias("high"),
        ))

    def values(b: Column) -> Column:
        low = F.when(b["star"], F.lit(least)).otherwise(b["low"])
        one = F.when(b["pieces"] == 2, F.lit(most)).otherwise(low)
        high = F.when(b["star"], F.lit(most)).when(b["ends"] == 2, b["high"]).when(b["ends"] == 1, one)
        right = (b["step"] > 0) & (low >= least) & (high <= most) & (low <= high)
        return F.when(right, F.sequence(low, high, F.when(b["step"] > 0, b["step"]).otherwise(F.lit(1))))

    parts = F.transform(F.split(text, ","), lambda part: _let(_let(F.split(F.trim(part), "/"), bounds), values))
    wrong = F.array().cast("array<int>")
    return _let(parts, lambda p: F.when(F.exists(p, lambda x: x.isNull()), wrong).otherwise(F.array_sort(F.array_distinct(F.flatten(p)))))


def parsed(expression: Column) -> Column:
    """A struct of the five sets, null unless there are five right fields; ``either`` where both kinds of days are narrowed, as then a day
    fires if one of them holds."""
    naming = (((), 0), ((), 0), ((), 0), (MONTHS, 1), (DAYS, 0))

    def sets(fields: Column) -> Column:
        found = [field_set(F.get(fields, F.lit(i)), *FIELDS[i], *naming[i]) for i in range(5)]
        found[4] = F.array_distinct(F.transform(found[4], lambda d: d % 7))
        either = (F.get(fields, F.lit(2)) != "*") & (F.get(fields, F.lit(4)) != "*")
        named = [x.alias(n) for x, n in zip(found, ("minutes", "hours", "days", "months", "weekdays"), strict=True)]
        return F.when(F.size(fields) == 5, F.struct(*named, either.alias("either")))

    def checked(s: Column) -> Column:
        right = F.lit(True)
        for n in ("minutes", "hours", "days", "months", "weekdays"):
            right = right & (F.size(s[n]) > 0)
        return F.when(right, s)

    return _let(_let(F.split(F.trim(expression), r"\s+"), sets), checked)


def _bits(values: Column) -> Column:
    """A number with the bits of ``values`` set."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x)))


def interval_minutes(schedules: DataFrame, key: str, expression: str, now: Column, otherwise: int = 60, days: int = 1500) -> DataFrame:
    """``(key, interval)``: minutes between the next two times after ``now`` at which each expression fires; ``otherwise`` for those that are
    wrong or fire less than twice within ``days``.

    A day fires as often as there are hours times minutes, at the same times each, so of each expression the first days that hold two times
    after ``now`` are enough: today and the next two that fire. They are found month by month, a month's days as bits of one number: the days
    asked for, and the weekdays moved by the month's first; days are laid out only of the first three months that have any.
    Rows with the same expression and time have the same answer, which is found once."""
    one = F.lit(1).cast("bigint")
    asked = schedules.select(key, F.col(expression).alias("_cron"), now.cast("timestamp_ntz").alias("_now"))
    sets = asked.select("_cron", "_now").distinct().withColumn("s", parsed(F.col("_cron")))
    today = F.to_date("_now")
    last = F.date_add(today, days)
    weeks = sum(1 << 7 * i for i in range(6))
    marks = sets.select(
        "*", (_bits(F.transform("s.days", lambda d: d - 1))).alias("_days"), (_bits(F.col("s.weekdays")) * F.lit(weeks).cast("bigint")).alias("_week"),
        F.transform(F.sequence(F.trunc(today, "month"), last, F.expr("interval 1 month")), lambda m: F.struct(
            m.alias("first"), F.month(m).alias("month"), (F.dayofweek(m) - 1).alias("weekday"),
            # the days of the month that lie between today and the last one
            (F.call_function("shiftleft", one, F.least(F.dayofmonth(F.last_day(m)), F.date_diff(last, m) + 1)) - F.call_function("shiftleft", one, F.greatest(F.date_diff(today, m), F.lit(0)))).alias("within"),
        )).alias("_months"),
    )

    def firing(m: Column) -> Column:
        week = F.call_function("shiftright", F.col("_week"), m["weekday"])
        both = F.when(F.col("s.either"), F.col("_days").bitwiseOR(week)).otherwise(F.col("_days").bitwiseAND(week))
        return F.struct(m["first"].alias("first"), F.when(F.array_contains("s.months", m["month"]), both.bitwiseAND(m["within"])).otherwise(F.lit(0)).alias("bits"))

    def laid_out(m: Column) -> Column:
        set_ = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda d: F.call_function("shiftright", m["bits"], d).bitwiseAND(one) == 1)
        return F.transform(set_, lambda d: F.date_add(m["first"], d))

    months = F.slice(F.filter(F.transform("_months", firing), lambda m: m["bits"] != 0), 1, 3)
    times = F.flatten(F.transform("s.hours", lambda h: F.transform("s.minutes", lambda m: h * 60 + m)))
    laid = marks.select("_cron", "_now", times.alias("times"), months.alias("_firing"))
    laid = laid.select("_cron", "_now", "times", F.slice(F.flatten(F.transform("_firing", laid_out)), 1, 3).alias("_firing"))
    minute = F.lit(60_000_000).cast("bigint")
    begun = F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.to_date("_now").cast("timestamp"))
    of_today = F.slice(F.filter("times", lambda t: t * minute > begun), 1, 2)  # times are in order
    chosen = F.transform("_firing", lambda d: F.struct(d.alias("day"), F.when(d == F.to_date("_now"), of_today).otherwise(F.slice("times", 1, 2)).alias("times")))
    at = F.flatten(F.transform(chosen, lambda x: F.transform(x["times"], lambda t: F.unix_micros(x["day"].cast("timestamp")) + t * minute)))
    rows = laid.select("_cron", "_now", F.slice(at, 1, 2).alias("_next"))
    gap = ((F.get("_next", F.lit(1)) - F.get("_next", F.lit(0))) / minute).cast("int")
    found = rows.select(F.col("_cron").alias("_c"), F.col("_now").alias("_n"), F.when(gap.isNull(), F.lit(otherwise)).otherwise(F.greatest(gap, F.lit(1))).alias("interval"))
    return asked.join(found, F.col("_cron").eqNullSafe(F.col("_c")) & F.col("_now").eqNullSafe(F.col("_n"))).select(key, "interval")
