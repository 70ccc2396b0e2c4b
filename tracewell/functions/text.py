"""Text, token and path-expression columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.ids import _col


def line_of(text: Column | str, offset: Column | int) -> Column:
    """One-based line of a zero-based character offset."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    head = F.substring(_col(text), F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def line_count(text: Column | str) -> Column:
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit("\n"), F.lit(""))) + 1


def first_match_line(text: Column | str, pattern: str) -> Column:
    """Line of the first match of ``pattern``, null without one."""
    at = F.regexp_instr(_col(text), F.lit(pattern))
    return F.when(at > 0, line_of(text, at - 1))


def preview(text: Column | str, limit: int = 120) -> Column:
    """One line, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def utf8_bytes(text: Column | str) -> Column:
    return F.octet_length(_col(text)).cast("long")


def legacy_tokens(text: Column | str) -> Column:
    return F.ceil(F.length(_col(text)) / 4)


_COUNTERS = {"utf8": utf8_bytes, "legacy": legacy_tokens}


def register_counter(name: str, counter) -> None:
    """Add a token counter: a function from a text column to a count column."""
    _COUNTERS[name] = counter


def count_tokens(text: Column | str, counter: str = "utf8") -> Column:
    return _COUNTERS[counter](text)


def access_segments(path: Column | str) -> Column:
    """Segments of ``a.b[0]["k"]``: a name, a number or a quoted key each."""
    return F.regexp_extract_all(_col(path), F.lit(r"([A-Za-z_$][\w$]*|\[\d+\]|\[\"[^\"]*\"\])"), F.lit(1))


def access_parent(path: Column | str) -> Column:
    """The path without its last segment; empty for a root."""
    return F.regexp_replace(_col(path), r"^[A-Za-z_$][\w$]*$|(\.[A-Za-z_$][\w$]*|\[\d+\]|\[\"[^\"]*\"\])$", "")


def is_descendant(path: Column, root: Column) -> Column:
    """True for a strict member or item path below ``root``; ``ab`` is not below ``a``."""
    return path.startswith(F.concat(root, F.lit("."))) | path.startswith(F.concat(root, F.lit("[")))


def display_name(symbol: Column | str, scopes: int = 2) -> Column:
    """Last scopes of ``path::a::b``; a symbol without scopes shows its file name."""
    parts = F.split(_col(symbol), "::")
    names = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    tail = F.slice(names, F.greatest(F.size(names) - scopes + 1, F.lit(1)), scopes)
    return F.when(F.size(parts) > 1, F.array_join(tail, ".")).otherwise(F.element_at(F.split(_col(symbol), "/"), -1))


def url_host(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[a-z]+://([^/?#]+)", 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[a-z]+://[^/?#]+/([^?#]*)", 1)


def value_identity(name: Column | str, object_slots: Column, explicit: Column, declarations: Column) -> Column:
    """Identity of a value: object slot, else explicit id, else declaration of the root plus the member path, else lexical."""
    name = _col(name)
    root = F.regexp_extract(name, r"^([^.\[]*)", 1)
    declared = F.when(root.rlike(r"^[A-Za-z_]\w*$"), F.element_at(declarations, root))
    return F.coalesce(
        F.element_at(object_slots, name), F.element_at(explicit, name),
        F.when(F.coalesce(declared, F.lit("")) != "", F.concat(declared, F.substring(name, F.length(root) + 1, F.length(name)))),
        F.concat(F.lit("lexical:"), name),
    )
