"""Scalar projections and predicates (P*, F*, S2, W4, W5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, WS_CLASS

# --- fixed values that must equal the reference --------------------------------
# Tokens pandas.read_csv turns into a missing value (whitespace-only is kept).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]
# Severity names -> class (code wins over README; README's 一般 is an alias).
SEVERITY_TO_LEVEL = {"轻微": 0, "中等": 1, "严重": 2}
SEVERITY_ALIASES = {"一般": "中等"}
LEVEL_TO_LABEL = {0: "轻微", 1: "中等", 2: "严重"}
# Night hours: 0-6 and 22-23.
NIGHT_BEFORE = 7
NIGHT_FROM = 22
# Value substituted for a missing location.
UNKNOWN_LOCATION = "未知"
# Time patterns searched (unanchored) in the raw time string, in this order.
FULL_TIME_PATTERN = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}" + WS + r"+\d{1,2}:\d{1,2}(:\d{1,2})?)"
YEARLESS_TIME_PATTERN = r"(\d{1,2}[-/]\d{1,2}" + WS + r"+\d{1,2}:\d{1,2}(:\d{1,2})?)"
# Caps used by the reference pipeline.
MAX_TWEETS = 2000
MAX_LEN = 300
TOPIC_PREFIX = "Topic: "
# -------------------------------------------------------------------------------

# Decimal / exponent / infinity forms pandas.to_numeric accepts. Spark's cast
# alone is looser (it takes `12d`, `12f`), hence this guard.
NUMERIC_PATTERN = (r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def na_to_null(col: Column | str) -> Column:
    """The read_csv missing tokens become null."""
    c = _c(col)
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def normalize_time(col: Column | str, default_year: int | Column | None = None) -> Column:
    """First full `Y-M-D H:M[:S]` match, else a year-less match prefixed with
    ``default_year`` (default: the current year), else null. `/` becomes `-`."""
    s = F.trim(_c(col).cast("string"))
    full = F.nullif(F.regexp_extract(s, FULL_TIME_PATTERN, 1), F.lit(""))
    short = F.nullif(F.regexp_extract(s, YEARLESS_TIME_PATTERN, 1), F.lit(""))
    if default_year is None:
        year = F.year(F.current_date()).cast("string")
    elif isinstance(default_year, Column):
        year = default_year.cast("string")
    else:
        year = F.lit(str(int(default_year)))
    return F.coalesce(F.replace(full, F.lit("/"), F.lit("-")),
                      F.concat(year, F.lit("-"), F.replace(short, F.lit("/"), F.lit("-"))))


def parse_time(col: Column | str) -> Column:
    """Normalised `Y-M-D H:M[:S]` string -> TIMESTAMP_NTZ; invalid dates or
    times (month 13, Feb 30, 24:00, :60) -> null.

    Built from the fields with ``try_make_timestamp_ntz``, so the result never
    depends on the session time zone (no DST gap shifts). One shape check and
    one split instead of a regex extraction per field.
    """
    s = F.regexp_replace(_c(col), f"{WS}+", " ")
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2})?$"
    parts = F.split(s, "[-: ]")

    def part(i):
        return F.try_element_at(parts, F.lit(i)).try_cast("int")
    sec = F.coalesce(part(6), F.lit(0))
    ts = F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), sec.cast("decimal(8,6)"))
    return F.when(s.rlike(shape) & (sec < 60), ts)


def post_time(col: Column | str, default_year: int | Column | None = None) -> Column:
    """P1 + P2 as one expression. On large inputs prefer normalising in one
    projection and parsing in the next (as ``features.typed_posts`` does), so
    the normalised string is computed once."""
    return parse_time(normalize_time(col, default_year))


def to_number(col: Column | str) -> Column:
    """Pandas.to_numeric(errors='coerce').fillna(0) as DOUBLE."""
    s = F.btrim(_c(col).cast("string"), F.lit(" \t\n\r\x0b\f"))
    parsed = F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))
    return F.when(F.isnan(parsed), F.lit(0.0)).otherwise(F.coalesce(parsed, F.lit(0.0)))


def location_or_unknown(col: Column | str) -> Column:
    """P4."""
    return F.coalesce(_c(col), F.lit(UNKNOWN_LOCATION))


def truncate(col: Column | str, n: int = MAX_LEN) -> Column:
    """First ``n`` code points."""
    return F.substring(_c(col), 1, n)


def topic_sentence(event: Column | str) -> Column:
    """The `Topic: {event}` sentence."""
    return F.concat(F.lit(TOPIC_PREFIX), _c(event))


def severity_level(col: Column | str, strict: bool = True) -> Column:
    """Severity name -> 0/1/2; unknown names raise (or null when not strict)."""
    c = _c(col)
    for alias, name in SEVERITY_ALIASES.items():
        c = F.when(c == alias, F.lit(name)).otherwise(c)
    expr = None
    for name, level in SEVERITY_TO_LEVEL.items():
        expr = (F.when(c == name, F.lit(level)) if expr is None else expr.when(c == name, F.lit(level)))
    if strict:
        return expr.otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(c, F.lit("null"))))).cast("int")
    return expr.cast("int")


def level_label(col: Column | str) -> Column:
    """Class -> label name."""
    return F.try_element_at(F.create_map(*[x for k, v in LEVEL_TO_LABEL.items() for x in (F.lit(k), F.lit(v))]),
                        _c(col).cast("int"))


def result_id(id_col: Column | str, pos_col: Column | str) -> Column:
    """P10: string id, falling back to the 0-based row ordinal."""
    return F.coalesce(F.nullif(_c(id_col).cast("string"), F.lit("")), _c(pos_col).cast("string"))


def unescape_path(col: Column | str, times: int = 1) -> Column:
    """Undo ``times`` rounds of %XX escaping of a path part (``+`` is literal).

    ``_metadata.file_path`` is URI-encoded (one round), a file listing
    (``binaryFile``'s ``path``) is raw (none), and Spark-written
    ``key=value`` folders add one round of their own.
    """
    c = _c(col)
    for _ in range(times):
        c = F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return c


def event_from_path(path: Column | str, decodes: int = 1) -> Column:
    """Event name = file stem (last dot), unescaped ``decodes`` times
    (1 for ``_metadata.file_path``, 0 for a raw listing path)."""
    return unescape_path(F.regexp_extract(_c(path), r"([^/]+)\.[^./]+$", 1), decodes)


def is_night(ts: Column | str) -> Column:
    """F4."""
    h = F.hour(_c(ts))
    return (h < NIGHT_BEFORE) | (h >= NIGHT_FROM)


def modality(valid: Column | str, has_image: Column | str) -> Column:
    """F5."""
    v, i = _c(valid), F.coalesce(_c(has_image), F.lit(False))
    return F.when(v & i, "multimodal").when(v, "text_only").otherwise("none")


def argmax(arr: Column | str) -> Column:
    """0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(arr: Column | str) -> Column:
    """Numerically stable softmax of a DOUBLE array."""
    a = _c(arr).cast("array<double>")
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def log_softmax(arr: Column | str) -> Column:
    """log(softmax(z)) computed as z - max - log(sum(exp(z - max)))."""
    a = _c(arr).cast("array<double>")
    m = F.array_max(a)
    lse = F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return F.transform(a, lambda x: x - m - lse)


__all__ = [n for n in dir() if not n.startswith("_")] + ["WS", "WS_CLASS"]
