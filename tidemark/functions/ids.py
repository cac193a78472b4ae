"""Identifiers, links and dates as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

REQUEST_ID_PATTERN = r"^(\d{8})_([^_]+)_c\d+$"
PATH_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_path(link: Column) -> Column:
    return F.regexp_extract(link, PATH_PATTERN, 1)


def submission_id_from_link(link: Column | str) -> Column:
    """The path segment after ``comments``; NULL when there is none."""
    link = F.col(link) if isinstance(link, str) else link
    parts = F.split(url_path(link), "/")
    at = F.array_position(parts, "comments")
    found = F.try_element_at(parts, (at + 1).cast("int"))
    return F.when(at > 0, F.nullif(found, F.lit("")))


def request_id(date: Column, submission_id: Column, index: Column) -> Column:
    return F.concat(date, F.lit("_"), submission_id, F.lit("_c"), index.cast("string"))


def parse_request_id(c: Column) -> tuple[Column, Column]:
    """Date and submission id; both NULL when the id is malformed."""
    ok = c.rlike(REQUEST_ID_PATTERN)
    return (
        F.when(ok, F.regexp_extract(c, REQUEST_ID_PATTERN, 1)),
        F.when(ok, F.regexp_extract(c, REQUEST_ID_PATTERN, 2)),
    )


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def epoch_to_day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd")


def parse_created(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(pattern))


def iso_or_raw(c: Column) -> Column:
    """ISO seconds when the text parses, else the text as it came."""
    return F.coalesce(F.date_format(parse_created(c), "yyyy-MM-dd'T'HH:mm:ss"), c)


def day_or_unknown(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_created(c), "yyyyMMdd"), F.lit("unknown_date"))


def day_to_date(c: Column) -> Column:
    return F.to_date(c, "yyyyMMdd")


def hours_from_text(c: Column) -> Column:
    """``24h`` or ``7d`` or a plain number, as hours."""
    c = F.lower(F.trim(c))
    number = F.regexp_extract(c, r"^(\d+)[hd]?$", 1).try_cast("int")
    return F.when(c.endswith("d"), number * 24).otherwise(number)


def money_to_double(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def double_to_money(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"$%.{digits}f", c)


def json_array_size(c: Column) -> Column:
    """Entries of a JSON ``comments`` value: list length, 1 for a non-empty scalar, else 0."""
    size = F.json_array_length(c)
    scalar = F.trim(F.coalesce(c, F.lit("")), F.lit('"'))
    blank = scalar.isin("", "null", "false", "0", "{}")
    return F.coalesce(size, F.when(blank, 0).otherwise(1))
