"""Column expressions shared by the operators. All of them stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bounds and labels of the listing summary.
PRICE_BANDS = [(0.9, "Below market"), (1.1, "At market")]
PRICE_BAND_ABOVE = "Above market"
PHOTO_BANDS = [(15, "Excellent"), (8, "Good"), (3, "Fair")]
PHOTO_BAND_BELOW = "Poor"
DESCRIPTION_BANDS = [(300, "Detailed"), (100, "Basic")]
DESCRIPTION_BAND_BELOW = "Minimal"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_diff_of(actual: Column | str, recommended: Column | str) -> Column:
    return _col(actual) - _col(recommended)


def price_ratio_of(actual: Column | str, recommended: Column | str) -> Column:
    """Ratio of the two prices; 0 when there is no positive recommendation."""
    rec = _col(recommended)
    return F.when(rec > 0, F.try_divide(_col(actual), rec)).otherwise(F.lit(0.0))


def _upper_bounded(value: Column, bands: Sequence[tuple], rest: str) -> Column:
    chain = F
    for bound, label in bands:
        chain = chain.when(value <= bound, label)
    return F.when(value.isNotNull(), chain.otherwise(rest))


def above_band(value: Column | str, bands: Sequence[tuple], rest: str) -> Column:
    """Label of the first band whose lower bound the value reaches, NULL for NULL."""
    value = _col(value)
    chain = F
    for bound, label in bands:
        chain = chain.when(value >= bound, label)
    return F.when(value.isNotNull(), chain.otherwise(rest))


def price_band(ratio: Column | str) -> Column:
    return _upper_bounded(_col(ratio), PRICE_BANDS, PRICE_BAND_ABOVE)


def photo_band(count: Column | str) -> Column:
    return above_band(count, PHOTO_BANDS, PHOTO_BAND_BELOW)


def description_band(length: Column | str) -> Column:
    return above_band(length, DESCRIPTION_BANDS, DESCRIPTION_BAND_BELOW)


def money_label(diff: Column | str) -> Column:
    """Signed whole-dollar text such as `+$5` or `$-12`."""
    diff = _col(diff)
    sign = F.when(diff >= 0, "+").otherwise("")
    return F.concat(sign, F.lit("$"), F.format_string("%d", F.round(diff).cast("long")))


def zero_filled(count: Column | str, source: Column | str, observed: Sequence[str]) -> Column:
    """Missing counts become 0 for observed sources and stay NULL for the others."""
    return F.coalesce(_col(count), F.when(_col(source).isin(*observed), F.lit(0)))


def as_missing(value: Column | str) -> Column:
    """NaN as NULL, as a double."""
    value = _col(value).cast("double")
    return F.when(~F.isnan(value), value)


def number_text(value: Column | str) -> Column:
    """Plain decimal text without a trailing `.0`; never exponent notation."""
    value = _col(value).cast("double")
    size = F.abs(value)
    plain = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    short = F.regexp_replace(value.cast("string"), r"\.0$", "")
    digits = value.try_cast("decimal(38,10)").cast("string")
    wide = F.regexp_replace(digits, r"\.?0+$", "")
    return F.when(plain, short).otherwise(F.coalesce(wide, value.cast("string")))


def week_ending_sunday(ts: Column | str) -> Column:
    """The Sunday that closes the Monday-to-Sunday week of `ts`, as a date."""
    day = _col(ts).cast("date")
    return F.date_add(day, F.pmod(F.lit(8) - F.dayofweek(day), F.lit(7)))


def micros_of(ts: Column | str, dtype: T.DataType) -> Column:
    """Microseconds since the epoch; wall-clock time for a type without a zone."""
    ts = _col(ts)
    if not isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(ts.cast("timestamp"))
    seconds = F.unix_date(ts.cast("date")) * F.lit(86400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def from_micros(micros: Column | str, dtype: T.DataType) -> Column:
    """The time of the given type that `micros_of` turned into microseconds."""
    micros = F.round(_col(micros)).cast("long")
    if not isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_micros(micros)
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def batch_time(as_of: datetime | str | Column | None) -> Column:
    """One timestamp for the whole query: the given one or the start of the query."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def rounded_map(values: Column | str, digits: int = 4) -> Column:
    return F.transform_values(_col(values), lambda _, v: F.round(v, digits))


def zipped_sum(left: Column | str, right: Column | str) -> Column:
    """Element-wise sum of two arrays; the query fails when their lengths differ."""
    left, right = _col(left), _col(right)
    summed = F.zip_with(left, right, lambda a, b: a + b)
    mismatch = F.raise_error(F.lit("arrays to add differ in length"))
    return F.when(left.isNull() | right.isNull(), F.lit(None)).otherwise(
        F.when(F.size(left) == F.size(right), summed).otherwise(mismatch)
    )
