"""Scalar building blocks as Column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(c(x) + F.lit(0.5)).cast("bigint")


def to_micros(x) -> Column:
    return half_up(c(x) * F.lit(1e6))


def from_micros(x) -> Column:
    return c(x).cast("double") / F.lit(1e6)


def round_to(x, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(c(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def round4(x) -> Column:
    return round_to(x, 4)


def money_mul(micros, factor) -> Column:
    return half_up(c(micros) * c(factor))


def money_div(micros, divisor) -> Column:
    """Money over a number, zero where the divisor is."""
    d = c(divisor)
    return F.when(d == 0, F.lit(0).cast("bigint")).otherwise(half_up(c(micros) / F.when(d != 0, d)))


def ratio_pct(part, whole) -> Column:
    w = c(whole)
    return F.when(w > 0, c(part) / F.when(w > 0, w) * 100.0).otherwise(F.lit(0.0))


def normalize_ticker(x) -> Column:
    return F.regexp_replace(F.upper(F.trim(c(x))), r"\.CA$", "")


def time_to_minutes(x) -> Column:
    """Minutes of a clock text, 12 or 24 hours; null where it is none."""
    t = F.upper(F.trim(c(x)))
    pattern = r"^(\d{1,2}):(\d{2})(?::\d{2})?\s*([AP]M)?$"
    hour, minute, half = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    h = hour.cast("int")
    h24 = F.when(half == "PM", F.when(h == 12, 12).otherwise(h + 12)).when(half == "AM", F.when(h == 12, 0).otherwise(h)).otherwise(h)
    return F.when(t.rlike(pattern), h24 * 60 + minute.cast("int"))


def known_time(minutes) -> Column:
    """Midnight counts as unknown."""
    return F.when(c(minutes) != 0, c(minutes))


def times_conflict(a, b) -> Column:
    """Both known and different; midnight is unknown."""
    x, y = known_time(a), known_time(b)
    return F.coalesce(x != y, F.lit(False))


def times_conflict_strict(a, b) -> Column:
    """Both given and different; midnight is a time like any other."""
    return F.coalesce(c(a) != c(b), F.lit(False))


def same_execution(a, b) -> Column:
    """True or false where both numbers are given, else null."""
    x, y = F.nullif(F.trim(c(a)), F.lit("")), F.nullif(F.trim(c(b)), F.lit(""))
    return x == y


def within(a, b, share: float) -> Column:
    """Prices that differ by no more than a share of the larger."""
    return F.abs(c(a) - c(b)) <= F.greatest(c(a), c(b)) * F.lit(share)


def one_digit_day_apart(a, b) -> Column:
    """Two days of one month whose two-digit numbers differ in one digit."""
    x, y = F.dayofmonth(c(a)), F.dayofmonth(c(b))
    tens, ones = F.floor(x / 10) != F.floor(y / 10), x % 10 != y % 10
    return (F.trunc(c(a), "month") == F.trunc(c(b), "month")) & (tens != ones)


def company_key(x) -> Column:
    """Upper case, no dots or commas, no legal form, single spaces. The legal forms."""
    bare = F.regexp_replace(F.upper(c(x)), "[.,]", "")
    forms = F.regexp_replace(bare, r"\b(LTD|CO|SAE|PLC|CORP|COMPANY)\b", "")
    return F.trim(F.regexp_replace(forms, r"\s+", " "))


def repair_digits(x) -> Column:
    """Letters that scans take for digits."""
    return F.translate(c(x), "OoTIl", "00111")


#: Marks without width and marks of direction, spaces, and digits and separators of
#: Arabic and Persian script with their ASCII forms.
NO_WIDTH = "[\\u200B-\\u200F\\u202A-\\u202E\\u2066-\\u2069\\uFEFF]"
SPACES = "[\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]"
ARABIC = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10)) + "\u066b\u066c"
ASCII = "01234567890123456789.,"


def clean_text(x) -> Column:
    """No zero-width or direction marks, plain spaces, Arabic and Persian digits and marks as ASCII."""
    t = F.regexp_replace(c(x), NO_WIDTH, "")
    plain = F.octet_length(c(x)) == F.length(c(x))  # none of these marks is a single byte
    return F.when(plain, c(x)).otherwise(F.translate(F.regexp_replace(t, SPACES, " "), ARABIC, ASCII))


def parse_price(x) -> Column:
    """A comma or dot before one to three last digits is a decimal mark; other commas group."""
    t, p = F.trim(c(x)), r"^([\d,]*\d)[.,](\d{1,3})$"
    decimal = F.concat(F.regexp_replace(F.regexp_extract(t, p, 1), ",", ""), F.lit("."), F.regexp_extract(t, p, 2))
    return F.when(t.rlike(p), decimal).otherwise(F.regexp_replace(t, ",", "")).try_cast("double")


def whole_shares(x, tolerance: float = 0.03) -> Column:
    near = half_up(x)
    return F.when(F.abs(c(x) - near) <= tolerance, near)


def excel_date(serial) -> Column:
    return F.date_add(F.to_date(F.lit("1899-12-30")), F.floor(c(serial)).cast("int"))


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(low)), F.lit(high))


def authority(source) -> Column:
    """Rank of a source of evidence.

    Fixed values: invoice 6, official-broker-excel 5, statement 4, orders-screen 3,
    orders-timeline 2, csv, notification, email, screenshot and other-document 1, manual and
    backfill 0, position-verification -1.
    """
    ranks = {"invoice": 6, "official-broker-excel": 5, "statement": 4, "orders-screen": 3, "orders-timeline": 2, "csv": 1, "notification": 1, "email": 1, "screenshot": 1, "other-document": 1, "manual": 0, "backfill": 0, "position-verification": -1}
    return F.create_map(*[F.lit(v) for kv in ranks.items() for v in kv])[c(source)]
