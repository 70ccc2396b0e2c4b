"""Content-derived identities: a prefix and the first 24 hex digits of a SHA-256 over joined fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = chr(31)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def digest_id(prefix: str, *fields: Column | str) -> Column:
    """Stable id over string or integer fields; floats print differently across engines."""
    joined = F.concat_ws(SEPARATOR, *[_col(f).cast("string") for f in fields])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def packed(ident: Column | str) -> Column:
    """Any text as bytes, 24 last hex digits as twelve: a digest of letters hardly shrinks where rows move. ``unpacked`` gives the text back."""
    text = _col(ident)
    short = F.concat(F.unhex(F.right(text, F.lit(24))), F.left(text, F.length(text) - 24).cast("binary"))
    return F.when(text.rlike(r"[0-9a-f]{24}\z"), F.concat(F.unhex(F.lit("01")), short)).otherwise(F.concat(F.unhex(F.lit("00")), text.cast("binary")))


def unpacked(code: Column | str) -> Column:
    code = _col(code)
    part = lambda start, *n: F.substring(code, start, *(n or (2**31 - 1,)))
    short = F.concat(part(14).cast("string"), F.lower(F.hex(part(2, 12))))
    return F.when(part(1, 1) == F.unhex(F.lit("01")), short).otherwise(part(2).cast("string"))


def _tidy(path: Column) -> Column:
    """Drop empty and single-dot segments, keep a leading slash (exactly two stay two)."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    lead = F.when(path.rlike("^//[^/]") | (path == "//"), "//").when(path.startswith("/"), "/").otherwise("")
    body = F.array_join(parts, "/")
    return F.when((lead == "") & (body == ""), ".").otherwise(F.concat(lead, body))


def file_id(path: Column | str) -> Column:
    """Forward slashes, no leading ``./``, no empty or dot segments."""
    bare = F.regexp_replace(F.replace(F.coalesce(_col(path), F.lit("")), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return F.when(bare == "", "").otherwise(_tidy(bare))


def symbol_id(path: Column | str, *scopes: Column | str) -> Column:
    return F.concat_ws("::", file_id(path), *[_col(s) for s in scopes])


def _spot(value: Column | str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(_col(value).cast("long"), F.lit(0)))


def location_id(path, line, column, end_line, end_column) -> Column:
    return digest_id("location:", file_id(path), _spot(line), _spot(column), _spot(end_line), _spot(end_column))


def callsite_id(path, line, column, end_line, end_column) -> Column:
    return F.regexp_replace(location_id(path, line, column, end_line, end_column), "^location:", "callsite:")


def declaration_id(owner, name, role, path, line, column, end_line, end_column) -> Column:
    """Empty unless all four coordinates are known."""
    whole = (_spot(line) != 0) & (_spot(column) != 0) & (_spot(end_line) != 0) & (_spot(end_column) != 0)
    spot = location_id(path, line, column, end_line, end_column)
    return F.when(whole, digest_id("declaration:", owner, name, role, spot)).otherwise("")


def fact_id(location: Column, kind, rule, symbol, name) -> Column:
    return digest_id("fact:", location, kind, rule, symbol, name)


def safe_relative_path(path: Column | str) -> Column:
    """Null for absolute paths, drives and parent segments; otherwise normalised."""
    text = F.replace(clean_text(path, 1000), F.lit("\\"), F.lit("/"))
    bad = (text == "") | text.startswith("/") | text.rlike("^.:") | text.rlike(r"(^|/)\.\.(/|$)")
    return F.when(~bad, _tidy(text))


def clean_text(value: Column | str, limit: int) -> Column:
    """No NUL, no outer blanks, at most ``limit`` characters; null becomes empty."""
    text = F.replace(F.coalesce(_col(value).cast("string"), F.lit("")), F.lit("\0"), F.lit(""))
    return F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, limit)


def positive_int(value: Column | str) -> Column:
    """Whole numbers above zero; anything else is null."""
    text = _col(value).cast("string")
    number = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text)).try_cast("bigint")
    return F.when(number > 0, number)


def json_digest(*fields: Column | str) -> Column:
    """SHA-256 of the compact JSON object; callers pass the fields in name order."""
    return F.sha2(F.to_json(F.struct(*[_col(f) for f in fields])), 256)
