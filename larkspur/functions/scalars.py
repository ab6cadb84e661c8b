"""Cell semantics of statistical tables as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.formats import FORMAT_KINDS

#: 1960-01-01 in days and seconds before 1970-01-01.
EPOCH_DAYS, EPOCH_SECONDS = 3653, 315_619_200
SAFE_INT = 9_007_199_254_740_992
MAX_LONG = 9.223372036854775807e18
MIN_DAY, MAX_DAY = -719_162, 2_932_896
#: Last day that a date of Spark and of DuckDB holds, and the first one negated, from 1970.
LAST_DAY = 2_147_483_646


def bind(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# --- text ---------------------------------------------------------------------------------------------------------


def rtrim_blank(c: Column) -> Column:
    """Trailing blanks and NULs go."""
    return F.regexp_replace(c, r"[ \x00]+$", "")


def is_blank(c: Column) -> Column:
    """Blanks and NULs only."""
    return rtrim_blank(c) == ""


def is_missing_text(c: Column) -> Column:
    return c.isNull() | is_blank(c)


def trim_unicode(c: Column) -> Column:
    """Unicode white space at both ends goes."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_format(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(c), r"^[. ]+|[. ]+$", ""))


def infer_kind(fmt: Column) -> Column:
    """double, date, datetime or time by the name of a numeric format."""
    f = normalise_format(F.coalesce(fmt, F.lit("")))
    any_of = lambda tests: F.greatest(*(x.cast("int") for x in tests), F.lit(0)) == 1
    out = F.lit("double")
    for kind, inside, starts, ends in reversed(FORMAT_KINDS):
        out = F.when(any_of([F.contains(f, F.lit(x)) for x in inside] + [f.startswith(x) for x in starts] + [f.endswith(x) for x in ends]), kind).otherwise(out)
    return out


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; other text stays."""
    raw = F.encode(c, "ISO-8859-1")
    low = ~c.rlike(r"[^\x00-\xFF]") & c.rlike(r"[\x80-\xFF]")
    return F.when(low, F.coalesce(F.try_validate_utf8(F.when(low, raw).cast("string")), c)).otherwise(c)


def has_controls(c: Column) -> Column:
    """Control characters (up to U+001F, U+007F to U+009F): a sign that text was read in a wrong encoding."""
    return c.rlike(r"[\x00-\x1F\x7F-\x9F]")


def shifted_ascii(a: Column, b: Column) -> Column:
    """Are two ASCII texts the same but for one character at an end, lost on one side, or shifted by one place?"""
    n, m = F.length(a), F.length(b)
    ascii_only = ~a.rlike(r"[^\x00-\x7F]") & ~b.rlike(r"[^\x00-\x7F]") & (n > 0) & (m > 0)
    tail, head = lambda c, k: F.substring(c, F.lit(2), k), lambda c, k: F.substring(c, F.lit(1), k)
    longer = (n == m + 1) & ((tail(a, m) == b) | (head(a, m) == b) | (tail(b, m) == head(a, m - 1)))
    equal = (n == m) & ((tail(b, n) == head(a, n - 1)) | (tail(a, n) == head(b, n - 1)))
    return ascii_only & (longer | equal)


def label_key(name: Column) -> Column:
    """Name under which a set of value labels is looked up: trimmed, no trailing dots, upper case."""
    return F.upper(F.regexp_replace(F.trim(name), r"\.+$", ""))


# --- numbers ------------------------------------------------------------------------------------------------------


def exact_int(c: Column) -> Column:
    """The double as bigint if it is a whole number in range, else null.  Subnormal numbers aren't whole."""
    return F.when((F.abs(c) < MAX_LONG) & (c % 1 == 0), F.when(F.abs(c) < MAX_LONG, c).cast("bigint"))


def as_bigint(c: Column, strict: bool = True) -> Column:
    """Whole numbers as bigint; others, and those out of range, are an error, or null if not strict."""
    found = exact_int(c.cast("double"))
    bad = F.raise_error(F.concat(F.lit("not an integer: "), c.cast("string"))).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when(found.isNotNull(), found).otherwise(bad)


def integer_kind(c: Column, width: int) -> Column:
    """How a number stored in `width` bytes is typed: int32 (up to 4 bytes), int64 (up to 8), or float if it isn't whole."""
    whole = exact_int(c.cast("double"))
    small = whole.between(-(1 << 31), (1 << 31) - 1) if width <= 4 else F.lit(False)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(whole.isNull(), "float").when(small, "int32").otherwise("int64")


def as_string(c: Column, type_name: str, strict: bool = True) -> Column:
    """Text cells as they are; other kinds are an error, or null if not strict."""
    if type_name in ("string", "binary"):
        return c.cast("string")
    bad = F.raise_error(F.concat(F.lit("not a text: "), c.cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(c.isNotNull(), bad)


def as_double(c: Column) -> Column:
    return c.cast("double")


def safe_double(c: Column, strict: bool = True) -> Column:
    """A bigint as double if it fits exactly in 53 bits; an error, or null, if not."""
    bad = F.raise_error(F.concat(F.lit("integer beyond 2**53: "), c.cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return F.when(c.isNull(), F.lit(None).cast("double")).when(F.abs(c) <= SAFE_INT, c.cast("double")).otherwise(bad)


def parse_double(c: Column, strict: bool = False) -> Column:
    """Trimmed text as double, empty text as null; other text is null, or an error if strict."""
    text = F.nullif(F.trim(c), F.lit(""))
    return text.cast("double") if strict else text.try_cast("double")


def number_text(c: Column) -> Column:
    """Text of a double: whole numbers plain, others as the shortest decimal that reads back the same."""
    whole = exact_int(c)
    sci = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(sci, "E", 1), r"\.0$", "")
    exponent = F.when(F.contains(sci, F.lit("E")), F.substring_index(sci, "E", -1).try_cast("int"))
    digits = F.translate(mantissa, "-.", "")
    sign = F.when(c < 0, "-").otherwise("")
    point = exponent + 1
    plain = F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)).otherwise(
        F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    )
    small = exponent.between(-5, 15)
    return (
        F.when(whole.isNotNull(), whole.cast("string"))
        .when(exponent.isNull(), sci)
        .when(small, F.concat(sign, plain))
        .otherwise(F.concat(mantissa, F.lit("e"), exponent.cast("string")))
    )


# --- missing values -----------------------------------------------------------------------------------------------


def bits_missing(bits: Column) -> Column:
    """Are these 64 bits (bigint) a NaN, and so a missing value?"""
    exp = F.lit(0x7FF0000000000000)
    return (bits.bitwiseAND(exp) == exp) & (bits.bitwiseAND(F.lit(0x000FFFFFFFFFFFFF)) != 0)


def bits_tag(bits: Column) -> Column:
    """Tag of a missing value: "_", "A".."Z", "." for the system's; null for numbers."""
    t = F.lit(255) - F.shiftrightunsigned(bits, 40).bitwiseAND(F.lit(255))
    tag = F.when(t == 0, "_").when(t.between(2, 27), F.char(t + 63)).otherwise(".")
    return F.when(bits_missing(bits), tag)


# --- dates and times ----------------------------------------------------------------------------------------------


def days_to_date(days: Column, any_year: bool = False) -> Column:
    """Days since 1960 as date, the fraction floored; out of the years 1 to 9999: null.

    any_year: null only where a date can't hold the day.  Python has no dates beyond those years, so such rows can be
    written and computed with, but not collected.
    """
    low, high = (-LAST_DAY, LAST_DAY) if any_year else (MIN_DAY, MAX_DAY)
    d = F.floor(F.when(days.between(-1e10, 1e10), days)) - EPOCH_DAYS
    return F.date_from_unix_date(F.when(d.between(low, high), d).cast("int"))


def _micros(seconds: Column) -> Column:
    size = F.abs(seconds)
    whole = F.floor(size)
    nanos = F.round((size - whole) * 1e9)
    sign = F.when(seconds < 0, -1).otherwise(1)
    return F.floor(sign * nanos / 1000) + sign * whole * 1_000_000


def seconds_to_timestamp(seconds: Column) -> Column:
    """Seconds since 1960 as timestamp, floored to microseconds; out of range: null."""
    low, high = MIN_DAY * 86400 + EPOCH_SECONDS, (MAX_DAY + 1) * 86400 + EPOCH_SECONDS
    ok = F.when((seconds >= low) & (seconds < high), seconds)
    return F.timestamp_micros(_micros(ok) - EPOCH_SECONDS * 1_000_000)


def seconds_to_micros(seconds: Column) -> Column:
    """A time of day or duration in microseconds, truncated."""
    return bind(seconds, lambda x: F.when(F.abs(x) < 9e12, F.when(x < 0, -1).otherwise(1) * _micros(F.abs(x))))


def seconds_to_interval(seconds: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds_to_micros(seconds) / 1_000_000).cast("decimal(18,6)"))


def timestamp_to_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6 + EPOCH_SECONDS


def as_datetime(c: Column, type_name: str) -> Column:
    """A datetime, or a date at midnight; other kinds are null."""
    return c.cast("timestamp_ntz") if type_name == "date" or type_name.startswith("timestamp") else F.lit(None).cast("timestamp_ntz")


def as_date(c: Column, type_name: str) -> Column:
    """A date, or the day of a datetime; other kinds are null."""
    return c.cast("date") if type_name == "date" or type_name.startswith("timestamp") else F.lit(None).cast("date")


def date_to_days(d: Column) -> Column:
    return F.unix_date(d) + EPOCH_DAYS


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def _millis_text(ms: Column) -> Column:
    return F.when(ms != 0, F.concat(F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise("")


def datetime_text(ts: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS, with .mmm if there are milliseconds; rounded half up to them."""
    ms = F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000)
    at = F.timestamp_millis(ms)
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), _millis_text(F.pmod(ms, F.lit(1000))))


def _time_text(negative: Column, ms: Column) -> Column:
    part = lambda div, mod: F.lpad((F.floor(ms / div) % mod).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    hours = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    sign = F.when(negative & (ms != 0), "-").otherwise("")
    return F.concat(sign, hours, F.lit(":"), part(60_000, 60), F.lit(":"), part(1000, 60), _millis_text(ms % 1000))


def time_text(micros: Column) -> Column:
    """[-]HH:MM:SS[.mmm] of a duration in microseconds; hours may exceed two digits."""
    return bind(micros, lambda m: bind(F.floor((F.abs(m) + 500) / 1000).cast("bigint"), lambda ms: _time_text(m < 0, ms)))


def parse_time(text: Column) -> Column:
    """HH:MM:SS[.ffffff] as microseconds."""
    p = F.split(text, ":")
    return ((F.get(p, F.lit(0)).try_cast("bigint") * 3600 + F.get(p, F.lit(1)).try_cast("bigint") * 60) * 1_000_000 + F.round(F.get(p, F.lit(2)).try_cast("double") * 1e6)).cast("bigint")


# --- cells ----------------------------------------------------------------------------------------------------------


def cell_kind(type_name: str) -> str:
    if type_name in ("date",):
        return "date"
    if type_name.startswith("timestamp"):
        return "datetime"
    if type_name.startswith("interval"):
        return "time"
    if type_name in ("tinyint", "smallint", "int", "bigint", "float", "double") or type_name.startswith("decimal"):
        return "number"
    return "bytes" if type_name == "binary" else "string"


def cell_number(c: Column, type_name: str) -> Column:
    """A cell's number: dates in days, datetimes and times in seconds since 1960; null for text."""
    kind = cell_kind(type_name)
    if kind == "date":
        return date_to_days(c).cast("double")
    if kind == "datetime":
        return timestamp_to_seconds(c)
    if kind == "time":
        return F.unix_micros(F.timestamp_micros(F.lit(0)) + c) / 1e6
    return c.cast("double") if kind == "number" else F.lit(None).cast("double")


def cell_json(c: Column, type_name: str) -> Column:
    """{"kind": ..., "value": ...} of a cell; a missing value has kind "missing" and null."""
    kind = cell_kind(type_name)
    value = c.cast("string") if kind in ("string", "bytes") else cell_number(c, type_name)
    keep = {"ignoreNullFields": "false"}
    return F.when(c.isNull(), F.lit('{"kind":"missing","value":null}')).otherwise(F.to_json(F.struct(F.lit(kind).alias("kind"), value.alias("value")), keep))
