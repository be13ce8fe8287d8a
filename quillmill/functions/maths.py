"""Numbers, durations, keys and levels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import col


def js_round(c: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(c + 0.5)


def reading_minutes(words: Column, per_minute: int = 150) -> Column:
    return js_round(words / per_minute)


def run_key(voice: Column, speed: Column, text: Column) -> Column:
    """16 hexadecimal digits that name a run by what it reads."""
    return F.substring(F.sha1(F.concat_ws("|", voice, speed.cast("string"), text)), 1, 16)


def clamp_speed(c: Column | str) -> Column:
    """Between 0.5 and 2; what is no number, null or 0 counts as 1."""
    x = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.cast("double")
    x = F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(1.0)).otherwise(x)
    return F.least(F.lit(2.0), F.greatest(F.lit(0.5), x))


def back_off(attempt: Column, retry_after: Column | None = None, base: float = 5.0, cap: float = 60.0) -> Column:
    """Seconds to wait before the next attempt: doubling, between 1 and ``cap``, unless told otherwise."""
    own = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return F.least(F.lit(cap), F.greatest(F.lit(1.0), own if retry_after is None else F.coalesce(retry_after, own)))


def clock_seconds(c: Column | str) -> Column:
    """Seconds of ``HH:MM:SS.ff``; null for anything else."""
    x = col(c)
    part = lambda n: F.expr("0.0") + F.nullif(F.regexp_extract(x, r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)\z", n), F.lit("")).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def colon_seconds(c: Column | str) -> Column:
    """Seconds of numbers between colons, the last being seconds; 0 for anything else."""
    x = F.trim(col(c))
    total = F.aggregate(F.split(x, ":"), F.lit(0.0).cast("double"), lambda a, p: a * 60 + F.coalesce(F.try_to_number(p, F.lit("999999")).cast("double"), F.lit(0.0)))
    return F.when(x.rlike(r"^\d{1,6}(:\d{1,6})*\z"), total).otherwise(F.lit(0.0))


def wait_text(seconds: Column) -> Column:
    """A wait for people: seconds below 90, else minutes."""
    return F.when(seconds < 90, F.format_string("%d s", js_round(seconds).cast("int"))).otherwise(F.format_string("%d min", js_round(seconds / 60).cast("int")))


def days_ago(now: Column, then: Column) -> Column:
    """Whole spans of 24 hours between two times."""
    return F.floor((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000))


def gain_for(target_db: Column | float, rms_db: Column, peak: Column, ceiling: float) -> Column:
    """The gain to a target level, kept so that the peak stays under the ceiling."""
    want = F.pow(F.lit(10.0), (F.lit(target_db) if isinstance(target_db, float) else target_db) / 20 - rms_db / 20)
    return F.when(peak > 0, F.least(want, F.lit(ceiling) / peak)).otherwise(want)


def level_from_ratio(c: Column) -> Column:
    """Heading level by size relative to the body: 1 from 1.5, 2 from 1.25, else 3."""
    return F.when(c >= 1.5, 1).when(c >= 1.25, 2).otherwise(3)


def stage_progress(done: Column, total: Column, stage: int = 0) -> Column:
    """Progress over three stages: the first goes from 0 to 70, the second to 80, the third to 100."""
    start, end = ((0, 70), (70, 80), (80, 100))[stage]
    return js_round(start + done * (end - start) / total)


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """What is left at the pace so far; null before anything is done."""
    return F.when(done > 0, (total - done) * elapsed / done)


def too_short(words: Column, seconds: Column, speed: Column, least_words: int = 20, per_second: float = 6.0) -> Column:
    """Whether sound is too short for its words to be whole."""
    return (words >= least_words) & (seconds > 0) & (seconds < words / (speed * per_second))


def byte_range(header: Column, size: Column) -> Column:
    """struct<first, last> of ``bytes=a-b``, ``a-`` or ``-n``; null where it lies outside."""
    m = lambda n: F.regexp_extract(header, r"^bytes=(\d*)-(\d*)\z", n)
    a, b = F.nullif(m(1), F.lit("")).cast("long"), F.nullif(m(2), F.lit("")).cast("long")
    first = F.when(a.isNotNull(), a).otherwise(F.greatest(F.lit(0), size - b))
    last = F.when(a.isNull(), size - 1).otherwise(F.least(F.coalesce(b, size - 1), size - 1))
    return F.when((a.isNotNull() | (b > 0)) & (first <= last) & (first < size), F.struct(first.alias("first"), last.alias("last")))


def http_error(status: Column) -> Column:
    """struct<code, retryable> of a service's answer."""
    code = F.when(status == 429, "RATE_LIMITED").when(status.isin(401, 403), "AUTH").when(status == 404, "MODEL_MISSING").when(status == 413, "TOO_LARGE").when(status >= 500, "SERVER").otherwise("BAD_REQUEST")
    return F.struct(code.alias("code"), code.isin("RATE_LIMITED", "SERVER").alias("retryable"))


def cost_text(factor: Column) -> Column:
    """How long an hour of sound takes, for people: minutes below 90, else hours to one place; null for unknown."""
    minutes = js_round(factor * 60)
    return F.when(minutes < 90, F.format_string("%d min", minutes.cast("int"))).when(minutes.isNotNull(), F.format_string("%.1f h", F.round(factor, 1)))


def added_when(now: Column, then: Column) -> Column:
    """today, yesterday, n days ago, or the date beyond a month; null for unknown times."""
    n = days_ago(now, then)
    return F.when(n <= 0, "today").when(n == 1, "yesterday").when(n < 30, F.format_string("%d days ago", n)).otherwise(F.date_format(then, "yyyy-MM-dd"))


def retry_after(value: Column, now: Column) -> Column:
    """Milliseconds to wait by a header of seconds or an HTTP date, never below 0; null for anything else."""
    seconds = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(value, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (F.unix_micros(date) - F.unix_micros(now)) / 1000
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds * 1000)).when(date.isNotNull(), F.greatest(F.lit(0.0), wait))


def track_seconds(played: Column, size: Column) -> Column:
    """Seconds of a track: its play time, else bytes at 16,000 a second, else 0."""
    return F.coalesce(F.nullif(colon_seconds(played), F.lit(0.0)), F.when(size > 0, js_round(size / 16000).cast("double")), F.lit(0.0))


def is_centred(x0: Column, x1: Column, left: Column, right: Column, body: Column, widest: float = 0.6, tolerance: float = 0.02) -> Column:
    """Whether a line stands in the middle of a column, with both margins clear and not over most of its width."""
    width = right - left
    middle = F.abs((x0 + x1) / 2 - (left + right) / 2)
    return (width > 0) & (x0 > left + body) & (right - x1 > body) & (x1 - x0 < widest * width) & (middle < tolerance * width)


def normal_noise(seed: int) -> Column:
    """A standard normal sample for each row."""
    return F.randn(seed)


def target_words(minutes: Column, speed: Column, book_words: Column, per_minute: int = 165, least: int = 450, share: float = 0.6) -> Column:
    """struct<target, code>: the words of a summary of some minutes, and why it cannot be made; null where it can."""
    target = F.floor(minutes * per_minute * speed)
    code = F.when(book_words < 200, "NO_TEXT").when(target < least, "SUMMARY_TOO_SHORT").when(target > book_words * share, "SUMMARY_TOO_LONG")
    return F.struct(target.alias("target"), code.alias("code"))
