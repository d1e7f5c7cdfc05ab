"""Dates of different precision, ages and schedules. No function reads the clock: each takes the moment it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}$"
PARTIAL = r"^\d{4}(?:-\d{2}(?:-\d{2})?)?$"
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$"
FRESH_DAYS = 14


def day(text: Column) -> Column:
    """The timestamp of a full day; a year or a month alone gives null, never an invented day."""
    return F.when(text.rlike(DAY), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def stamp(text: Column) -> Column:
    return F.when(text.rlike(STAMP), F.try_to_timestamp(text))


def partial_text(text: Column) -> Column:
    """A year, a month and year, or a day, as people write it."""
    return (
        F.when(text.rlike(r"^\d{4}$"), text)
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.date_format(F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")), "MMM yyyy"))
        .when(text.rlike(DAY), F.date_format(day(text), "d MMM yyyy"))
    )


def fresh(funded: Column, role_seen: Column, as_of: Column, days: int = FRESH_DAYS) -> Column:
    """struct<kind, at>: the newer of two timestamps that lies in the last days, and not over a day ahead."""
    ok = lambda t: (t >= as_of - F.make_dt_interval(F.lit(days))) & (t <= as_of + F.make_dt_interval(F.lit(1)))
    gated = F.array_compact(
        F.array(*[F.when(ok(t), F.struct(t.alias("at"), F.lit(n).alias("order"), F.lit(k).alias("kind"))) for n, (k, t) in enumerate((("role", role_seen), ("funding", funded)))])
    )
    best = F.array_max(gated)
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), best["at"].alias("at")))


def age_days(at: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)


def is_stale(at: Column, as_of: Column, threshold_days: int) -> Column:
    """True for what was checked too long ago, or never."""
    return F.coalesce(age_days(at, as_of) > threshold_days, F.lit(True))


def unit(seed: Column) -> Column:
    """A number in [0, 1) fixed by a text: the first four bytes of its SHA-256."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("double") / 2**32


def jitter(seed: Column, amount: float) -> Column:
    return 1 + amount * (2 * unit(seed) - 1)


def interval_days(base: float, growth: float, streak: Column, low: float, high: float, seed: Column, amount: float) -> Column:
    """Days until the next check: longer after each unchanged one, up to six, with a jitter, within bounds."""
    grown = F.lit(base) * F.pow(F.lit(growth), F.least(streak, F.lit(6)))
    return F.least(F.lit(high), F.greatest(F.lit(low), grown * jitter(seed, amount)))


# Minutes to wait after each failure in a row, and days after a failed check.
BACKOFF_MINUTES = (15, 60, 180, 360, 720, 1440)
FAILURE_DAYS = (0.25, 1.0, 3.0, 7.0, 14.0)


def backoff_minutes(failures: Column, transient: Column | None = None, retry_after_seconds: Column | None = None) -> Column:
    """The wait after so many failures in a row: the ladder, or what the server asked for if longer, a day at most."""
    ladder = F.array(*map(F.lit, BACKOFF_MINUTES))
    step = F.element_at(ladder, F.least(F.greatest(failures, F.lit(1)), F.lit(len(BACKOFF_MINUTES))).cast("int")).cast("double")
    if retry_after_seconds is not None:
        step = F.greatest(step, F.least(F.coalesce(retry_after_seconds, F.lit(0)) / 60.0, F.lit(1440.0)))
    return step if transient is None else F.when(~transient, F.lit(float(BACKOFF_MINUTES[-1]))).otherwise(step)


def half_day_block(at: Column) -> Column:
    """The number of the twelve-hour block of a moment."""
    return F.floor(F.unix_timestamp(at) / 43200)


def to_utc(local: Column, zone: Column) -> Column:
    """The moment of a local time in a zone; a day alone is its first minute there."""
    text = F.when(local.rlike(DAY), F.concat(local, F.lit("T00:00"))).otherwise(local)
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")), zone)


def event_span(starts: Column, ends: Column, zone: Column) -> Column:
    """struct<from, to> in UTC: an end that is a day lasts until the day is over; without an end a day lasts one day."""
    last = F.coalesce(ends, starts)
    day_end = F.to_utc_timestamp(F.date_add(F.try_to_timestamp(F.when(last.rlike(DAY), last), F.lit("yyyy-MM-dd")), 1).cast("timestamp"), zone)
    return F.struct(to_utc(starts, zone).alias("from"), F.when(last.rlike(DAY), day_end).otherwise(to_utc(last, zone)).alias("to"))


#: Days after which a check is said to need another.
RECHECK_DAYS = 60


def verified_label(at: Column, as_of: Column, recheck_days: int = RECHECK_DAYS) -> Column:
    """How long ago something was checked, in words; null if never."""
    d = F.greatest(age_days(at, as_of), F.lit(0))
    return (
        F.when(at.isNull(), None)
        .when(d > recheck_days, "Needs re-check")
        .when(d == 0, "Verified today")
        .when(d == 1, "Verified yesterday")
        .when(d < 14, F.format_string("Verified %d days ago", d))
        .otherwise(F.format_string("Verified %d weeks ago", F.floor(d / 7)))
    )


# The two daily windows of the refresh, in local time.
SLOT_ZONE, SLOTS = "Australia/Melbourne", (("AM", 8, 12), ("PM", 20, 24))


def slot(at: Column) -> Column:
    """The window that a UTC moment lies in, as 'yyyy-MM-dd AM' of the local day; null outside both."""
    local = F.from_utc_timestamp(at, SLOT_ZONE)
    name = F.lit(None).cast("string")
    for code, low, high in SLOTS:
        name = F.when((F.hour(local) >= low) & (F.hour(local) < high), code).otherwise(name)
    return F.when(name.isNotNull(), F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd"), name))


#: Twelve-hour blocks after which every record has had its turn.
ROTATION_BLOCKS = 14


def rotation_bucket(key: Column) -> Column:
    """FNV-1a of a text's code points, modulo ROTATION_BLOCKS: which block of the rotation is a record's own."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619) % 4294967296
    return (F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step) % ROTATION_BLOCKS).cast("int")
