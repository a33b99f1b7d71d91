"""Column expressions: codes, counts, statuses, categories, flags, dates, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text forms of a count that was suppressed or is unknown.
SUPPRESSED = ("", "-", "n", "nan", "suppressed", "u")
TRUE_WORDS = ("1", "true", "t", "yes", "y")
EARTH_MILES = 3958.8
MM_PER_INCH = 25.4
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_code(c: Column, width: int = 5) -> Column:
    """A code of digits, trimmed, without a decimal part, padded with zeros; null if anything else is in it."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r"\.0*$", "")
    return F.when(bare.rlike(r"^[0-9]+$"), F.lpad(bare, width, "0"))


def is_suppressed(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(*SUPPRESSED)


def parse_count(c: Column) -> Column:
    """A count from text with thousands separators; suppressed and unknown forms are 0."""
    return F.when(is_suppressed(c), F.lit(0)).otherwise(F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double").try_cast("bigint"))


def parse_int(c: Column) -> Column:
    """Whole numbers, also written as 12.0; anything else is null."""
    value = blank_to_null(c).try_cast("double")
    return F.when(value == F.floor(value), value.cast("bigint"))


def parse_float(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUE_WORDS)


def normalize_status(c: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), F.lit("")), F.lit("unknown"))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def name_key(c: Column) -> Column:
    """Names that differ in case, punctuation or `&` for `and` share a key."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")


def bucketize(c: Column, bounds: Sequence[tuple[float, str]], last: str, missing: str | None = None) -> Column:
    """The label of the first bound that c is below; last if none, missing if c is null."""
    out = F.when(c.isNull(), F.lit(missing))
    for bound, label in bounds:
        out = out.when(c < bound, F.lit(label))
    return out.otherwise(F.lit(last))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    out = None
    for condition, label in rules:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def climate_phase(anomaly: Column) -> Column:
    return F.when(anomaly >= 0.5, "warm").when(anomaly <= -0.5, "cool").when(anomaly.isNotNull(), "neutral")


def scaled(c: Column, high: float) -> Column:
    return F.least(F.greatest(c / high, F.lit(0.0)), F.lit(1.0))


def rate(numerator: Column, denominator: Column, per: float = 1.0) -> Column:
    """numerator / denominator * per; null where the denominator is missing or not positive."""
    return F.when(denominator > 0, numerator / denominator * per)


def pct_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / before * 100.0)


def shrunk_mean(mean: Column, n: Column, prior: Column, strength: float) -> Column:
    if strength == 0:
        return mean
    return (n * F.coalesce(mean, F.lit(0.0)) + strength * prior) / (n + strength)


# Flags: arrays of strings in memory, joined by commas at sinks


def flags_split(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def flags_union(*flags: Column) -> Column:
    """All flags once, in the order of their first occurrence."""
    return F.array_distinct(F.concat(*flags))


def flags_sorted_union(flags: Column) -> Column:
    """Aggregate: all flags of a group, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(flags))))


def flags_allowed(flags: Column, allowed: Sequence[str]) -> Column:
    return F.array_intersect(flags, F.array(*map(F.lit, allowed)))


def flag_when(flags: Column, condition: Column, flag: str) -> Column:
    return F.concat(flags, F.when(condition, F.array(F.lit(flag))).otherwise(F.array().cast("array<string>")))


def flags_text(flags: Column) -> Column:
    return F.concat_ws(",", flags)


# Dates


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("int")


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def _mmwr_start(year: Column) -> Column:
    """The Sunday on or before January 4."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_sub(fourth, F.dayofweek(fourth) - 1)


def mmwr_year(d: Column) -> Column:
    y = F.year(d)
    return F.when(d >= _mmwr_start(y + 1), y + 1).when(d < _mmwr_start(y), y - 1).otherwise(y)


def mmwr_week(d: Column) -> Column:
    return (F.floor(F.datediff(d, _mmwr_start(mmwr_year(d))) / 7) + 1).cast("int")


def mmwr_date(year: Column, week: Column) -> Column:
    return F.date_add(_mmwr_start(year), (week - 1) * 7)


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)) + 1, F.lit(0))


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.trim(name))).cast("int"), F.lit(0))


def parse_date(c: Column) -> Column:
    """ISO or M/D/YYYY dates."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "M/d/yyyy"))


# Numbers and text


def round6(c: Column) -> Column:
    return F.round(c, 6)


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("bigint")


def haversine_miles(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    dlat, dlon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def inches_to_mm(c: Column) -> Column:
    return c * MM_PER_INCH


def mask_secrets(c: Column) -> Column:
    """Values of keys, tokens and passwords in URLs and commands become ***."""
    return F.regexp_replace(c, r"(?i)((?:api_?key|key|token|secret|password)=)[^&\s]+", "$1***")


def has_secret(c: Column) -> Column:
    return c.rlike(r"(?i)(?:api_?key|key|token|secret|password)=[^&\s*]+")


def locator_kind(c: Column) -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), "missing").when(c.rlike(r"^https?://[^/\s]+"), "url").when(c.contains("://"), "other").otherwise("local")


def decode_period(code: Column, first: int, last: int, base: int) -> Column:
    """Coded periods first..last as base + code; other codes are null."""
    return F.when(code.between(first, last), code + base)
