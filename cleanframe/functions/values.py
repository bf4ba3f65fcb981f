"""Row-local Column expressions for messy cells.

Everything here is built from Spark's own functions and works the same on batch
and streaming frames. Malformed input turns into null instead of an ANSI cast
error. Where an input is bound by `once`, Spark compiles the projection but not
its lambda; common notations are settled by a pattern before costlier ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..errors import SpecError

# The characters Python's str.strip() removes.
WHITESPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)

# The date and time notations tried by default, in this order.
# Day-first and month-first notations contradict each other, so only the
# unambiguous ones are defaults; callers add theirs per column.
ISO_DATES = ["yyyy-MM-dd", "yyyy/MM/dd"]
ISO_TIMES = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy/MM/dd HH:mm",
]
DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d/M/yyyy HH:mm"]
MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy", "M/d/yyyy HH:mm", "M-d-yyyy HH:mm"]
DEFAULT_FORMATS = ISO_DATES + ISO_TIMES

_NUMBER = r"^[+-]?(\d++(\.\d*+)?|\.\d++)([eE][+-]?\d++)?$"
_INTEGER = r"^[+-]?\d+$"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def once(c: Column, body) -> Column:
    """body(c), with c evaluated once however often the body uses it.

    Without this, a derived input would be copied into the plan for every use,
    and again for every filter that Spark pushes below a projection.
    """
    return F.get(F.transform(F.array(c), lambda x: body(x)), F.lit(0))


def computed(df: DataFrame, *columns) -> DataFrame:
    """select(), for costly columns that filters will look at.

    Spark pushes filters below a plain projection and computes the columns they
    use a second time; it does not push them below a generator.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only spaces."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


# Names of the time zone in which times are read and written.
_UTC = {"UTC", "Z", "GMT", "Etc/UTC", "Etc/GMT", "+00:00", "UTC+0", "GMT+0"}


def need_utc() -> None:
    """Refuse to build an expression on times in a session of another time zone, where it would shift them."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    if zone not in _UTC:
        raise SpecError(f"times are read and written in UTC; set spark.sql.session.timeZone to UTC instead of {zone}")


def present(c: Column, dtype: T.DataType) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c


def nullify(c: Column, null_like=(), dtype: T.DataType | None = None) -> Column:
    """Turn NaN and the listed texts into null. Non-text columns cannot hold the texts."""
    if dtype is not None:
        c = present(c, dtype)
    if not null_like or (dtype is not None and not isinstance(dtype, T.StringType)):
        return c
    return F.when(~c.isin(list(null_like)), c)


def try_num(c: Column, dtype: T.DataType | None = None) -> Column:
    """The cell as a finite double, or null.

    Text is checked first because Java's parser also accepts `5d` and `nan`.
    """
    if dtype is not None and isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(c) < F.lit(float("inf")), c.cast("double"))
    if dtype is not None and is_numeric(dtype):
        return c.cast("double")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("double")
    return _text_num(strip(c))


def _finite(number: Column) -> Column:
    return once(number, lambda n: F.when(F.abs(n) < F.lit(float("inf")), n))


def _text_num(text: Column) -> Column:
    return _finite(F.when(text.rlike(_NUMBER), text.try_cast("double")))


def to_whole(c: Column, dtype: T.DataType | None = None, mode: str = "round") -> Column:
    """The cell as a bigint: half-even rounding, or truncation; null if unreadable."""
    if dtype is not None and isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")

    def whole(number):
        rounded = F.rint(number) if mode == "round" else number
        return F.when(F.abs(number) < F.lit(9.2e18), rounded.cast("bigint"))

    if dtype is not None and not isinstance(dtype, T.StringType):
        return once(try_num(c, dtype), whole)
    # long digit strings must not pass through a double
    return once(
        strip(c),
        lambda text: F.coalesce(
            F.when(text.rlike(_INTEGER), text.try_cast("bigint")), once(_text_num(text), whole)
        ),
    )


def title(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), ""
    )


def _shape(fmt: str) -> str:
    """A regular expression of the texts a date format can read.

    Testing it first keeps Spark from raising and catching a parse error for
    each format and row that do not fit together.
    """
    out, i = "", 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            end = fmt.index("'", i + 1)
            out, i = out + fmt[i + 1 : end], end + 1
            continue
        run = len(fmt) - len(fmt[i:].lstrip(ch)) - i
        if ch == "X":
            out += r"(Z|[+-]\d{2}:\d{2})"
        elif ch.isalpha():
            out += r"\d{%d}" % run if run > 1 else r"\d{1,2}"
        else:
            out += ("\\" + ch if ch in ".+*?()[]{}|^$\\" else ch) * run
        i += run
    return f"^{out}$"


def parse_timestamp(c: Column, formats=None, dtype: T.DataType | None = None) -> Column:
    """The cell as a timestamp by the first format that reads it, or null."""
    need_utc()
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if dtype is not None and not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp")  # bare numbers are epochs, see epoch()
    return once(strip(c), lambda text: _text_timestamp(text, formats))


# Notations that Spark's own cast to timestamp reads, faster.
_CAST_FORMATS = {"yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX"}


def _text_timestamp(text: Column, formats) -> Column:
    def read(fmt):
        return text.try_cast("timestamp") if fmt in _CAST_FORMATS else F.try_to_timestamp(text, F.lit(fmt))

    return F.coalesce(*[F.when(text.rlike(_shape(f)), read(f)) for f in (formats or DEFAULT_FORMATS)])


def parse_date(c: Column, formats=None, dtype: T.DataType | None = None) -> Column:
    return F.to_date(parse_timestamp(c, formats, dtype))


@dataclass(frozen=True)
class EpochRule:
    """From which size on an epoch is in milliseconds, and which seconds are valid."""

    threshold: float
    lowest: float
    highest: float
    both_signs: bool


# The epoch rule of the cleaning operation (nanosecond clock) and
# the one of the report feeds (calendar years 1 to 9999).
OPERATION_EPOCH = EpochRule(1e11, -9_223_372_036, 9_223_372_036, True)
FEED_EPOCH = EpochRule(1e10, -62_135_596_800, 253_402_300_799, False)


def epoch(number: Column, rule: EpochRule = OPERATION_EPOCH) -> Column:
    """Epoch seconds or milliseconds as a timestamp; null if out of range."""
    return once(number, lambda n: _epoch(n, rule))


def _epoch(n: Column, rule: EpochRule) -> Column:
    in_ms = (F.abs(n) if rule.both_signs else n) > rule.threshold
    in_seconds = (n >= rule.lowest) & (n < rule.highest + 1)
    valid_ms = (n >= rule.lowest * 1e3) & (n < (rule.highest + 1) * 1e3)
    micros = F.when(in_ms, F.when(valid_ms, n * 1e3)).when(in_seconds, n * 1e6)
    return F.timestamp_micros(F.rint(micros).cast("bigint"))


def mixed_timestamp(
    c: Column,
    formats=None,
    dtype: T.DataType | None = None,
    rule: EpochRule = FEED_EPOCH,
    digits: str | None = None,
) -> Column:
    """Epoch numbers, digit strings and written timestamps in one column.

    `digits` limits which digit strings count as epochs, e.g. r"^\\d{10,13}$".
    """
    need_utc()
    if dtype is not None and not isinstance(dtype, T.StringType):
        if is_numeric(dtype):
            return epoch(try_num(c, dtype), rule)
        return parse_timestamp(c, formats, dtype)
    return once(
        strip(c),
        lambda text: F.when(
            text.rlike(digits or _NUMBER), once(text.try_cast("double"), lambda n: _epoch(n, rule))
        ).otherwise(_text_timestamp(text, formats)),
    )


def time_bucket(ts: Column, minutes: int) -> Column:
    """Start of the fixed bucket of that many minutes around a timestamp."""
    width = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / F.lit(width)) * F.lit(width))


def first_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\p{Nd}+)", 1), F.lit(""))


def all_digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c.cast("string"), r"\P{Nd}", ""), F.lit(""))


def drug_name(c: Column) -> Column:
    """Stripped lower-case text; a missing name is the empty text."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def dosage(c: Column, dtype: T.DataType | None = None) -> Column:
    """The number itself, or the first unsigned number inside the text."""
    if dtype is not None and is_numeric(dtype):
        return try_num(c, dtype)
    return _finite(F.regexp_extract(c.cast("string"), r"(\d++(?:\.\d++)?)", 1).try_cast("double"))


def bed_label(c: Column) -> Column:
    """`Room 007` becomes `BED-7`; without any digit `BED-UNKNOWN`."""
    digits = F.regexp_replace(first_digits(c), r"^0+(?=\p{Nd})", "")
    return F.concat(F.lit("BED-"), F.coalesce(digits, F.lit("UNKNOWN")))


def recent(ts: Column, reference, days: int) -> Column:
    """Whether a timestamp is at most so many days before the reference, or later."""
    ref = reference if isinstance(reference, Column) else F.lit(reference).cast("timestamp")
    return ts >= ref - F.make_dt_interval(F.lit(days))


def _float_text(x: Column) -> Column:
    """A double the way Python prints it: 7.0, 0.001, 12345678.9, 1e+16; NaN is null."""
    size = F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0*$", "$1")
    infinity = F.lit(float("inf"))
    return (
        F.when(F.isnan(x) | x.isNull(), None)
        .when(size == infinity, F.when(x > 0, "inf").otherwise("-inf"))
        .when(x == 0, "0.0")
        .when((size < 1e16) & (size >= 1e-4), plain)
        .otherwise(once(F.split(x.cast("string"), "E"), _scientific))
    )


def _scientific(parts: Column) -> Column:
    power = F.get(parts, F.lit(1)).cast("int")
    digits = F.abs(power).cast("string")
    return F.concat(
        F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )


def as_text(c: Column, dtype: T.DataType) -> Column:
    """The cell as Python would print it."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return once(c.cast("double"), _float_text)
    return c.cast("string")


# Integers that already are their canonical text.
_PLAIN_INTEGER = r"^(0|-?[1-9]\d{0,17})$"


# Decimals of up to 17 digits before and after the point that already are their canonical text,
# and those that only have zeros, or a bare point, too many at the end.
_PLAIN_DECIMAL = r"^(?!-0$)-?(0|[1-9]\d{0,16})(\.\d{0,16}[1-9])?$"
_PADDED_DECIMAL = r"^(?!-0\.0*$)-?(0|[1-9]\d{0,16})\.\d{0,17}$"

# Sign, whole part, fraction and exponent of a number's text.
_PARTS = r"^([+-]?)0*+(\d*+)(?:\.(\d*+))?(?:[eE]([+-]?\d++))?$"


def _bound(value: str, name: str, body: str) -> str:
    """`once` in SQL text."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _part(i: int) -> str:
    return f"regexp_extract(t, r'{_PARTS}', {i})"


# SQL text, which the session parses in one call; put together call by call, every column that is
# compared would cost the driver a third of a second.
_WRITTEN = """CASE WHEN z.digits = '' THEN '0' ELSE concat(CASE WHEN z.minus THEN '-' ELSE '' END, CASE
    WHEN z.point BETWEEN 1 AND 38 AND length(z.digits) <= z.point THEN rpad(z.digits, int(z.point), '0')
    WHEN z.point BETWEEN 1 AND 38 THEN concat(substr(z.digits, 1, int(z.point)), '.', substr(z.digits, int(z.point) + 1))
    WHEN z.point BETWEEN -17 AND 0 THEN concat('0.', repeat('0', int(-z.point)), z.digits)
    ELSE concat(substr(z.digits, 1, 1), CASE WHEN length(z.digits) > 1 THEN concat('.', substr(z.digits, 2)) ELSE '' END,
        'e', string(z.point - 1)) END) END"""
_UNPADDED = """named_struct('minus', y.minus, 'digits', trim(TRAILING '0' FROM trim(LEADING '0' FROM y.digits)),
    'point', y.point - length(y.digits) + length(trim(LEADING '0' FROM y.digits)))"""
_TAKEN_APART = f"""named_struct('minus', {_part(1)} = '-', 'digits', concat({_part(2)}, {_part(3)}),
    'point', length({_part(2)}) + coalesce(try_cast({_part(4)} AS bigint), CASE WHEN {_part(4)} = '' THEN 0 END))"""
_NUMBER_FORM = f"""t -> CASE WHEN t RLIKE r'{_PLAIN_DECIMAL}' THEN t
    WHEN t RLIKE r'{_PADDED_DECIMAL}' THEN trim(TRAILING '.' FROM trim(TRAILING '0' FROM t))
    WHEN t RLIKE r'{_NUMBER}' THEN {_bound(_TAKEN_APART, "y", _bound(_UNPADDED, "z", _WRITTEN))} END"""


def _number_form(c: Column) -> Column:
    """One text per numeric value, exact for any number of digits.

    The digits without zeros at either end, and where the point stands, make the number. It is
    written out if it has up to 38 whole digits or 17 zeros after the point, and with an exponent else.
    """
    return F.get(F.call_function("transform", F.array(c.cast("string")), F.expr(_NUMBER_FORM)), F.lit(0))


def canonical(c: Column, dtype: T.DataType, mode: str = "value") -> Column:
    """The text under which two cells count as equal.

    mode "value": `7`, `"7"` and `7.0` are equal, and so are ` ICU ` and `icu`.
    mode "text":  stripped lower-case text only; null equals the empty text.
    """
    if mode == "text":
        return F.coalesce(F.lower(strip(as_text(c, dtype))), F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "1").when(~c, "0")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return once(c, _canonical_double)
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return once(c, _number_form)
    if isinstance(dtype, T.StringType):
        return once(
            strip(c), lambda t: _canonical_text(t).otherwise(F.when(F.lower(t) != "nan", F.lower(t)))
        )
    return c.cast("string")


def _canonical_text(t: Column) -> Column:
    number = F.coalesce(_number_form(t), F.lower(t))
    return F.when(t.rlike(_PLAIN_INTEGER), t).when(t.rlike(_NUMBER), number)


def _canonical_double(x: Column) -> Column:
    text = F.lower(F.when(~F.isnan(x), x.cast("string")))
    whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(F.coalesce(_number_form(x), text))


def sort_text(c: Column, dtype: T.DataType) -> Column:
    """The text by which canonical rows are ordered; a missing cell is `None`."""
    if isinstance(dtype, T.StringType):
        shown = once(
            strip(c),
            lambda t: once(
                _canonical_text(t).otherwise(F.lower(t)),
                lambda n: F.when(t.rlike(_NUMBER), _as_float(n, t.rlike("[.eE]"))).otherwise(n),
            ),
        )
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        shown = once(once(c, _canonical_double), lambda n: _as_float(n, n.rlike(r"^-?\d+$")))
    else:
        shown = as_text(c, dtype)
    return F.coalesce(shown, F.lit("None"))


def _as_float(number: Column, is_float: Column) -> Column:
    """Whole floats read 7.0."""
    return F.concat(number, F.when(is_float & ~number.contains("."), ".0").otherwise(""))
