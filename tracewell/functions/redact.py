"""Masking of secrets in source text, log lines and JSON documents; line structure is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.ids import _col
from tracewell.functions import secret_patterns as secrets
from tracewell.functions.secret_patterns import MASK

def _mask_lines(text: Column) -> Column:
    """Every non-empty line becomes the mask; a leading line number stays."""
    return F.regexp_replace(text, r"(?m)^([0-9]+:[ \t]*)?[^\r\n]+", "$1[REDACTED]")


def _mask_spans(text: Column, pattern: str, mask) -> Column:
    """The text with each match of ``pattern`` replaced by ``mask(match)``.

    The text is split at the matches and joined again around the masks: a match is never looked up
    by its text, which may occur elsewhere too.
    """
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    joined = F.zip_with(between, spans, lambda part, span: F.concat(part, F.coalesce(mask(span), F.lit(""))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(joined, ""))


def _mask_triple(span: Column) -> Column:
    head = F.regexp_extract(span, r"(?is)^(.*?(?:\"{3}|'{3}))", 1)
    quote = F.substring(span, -3, 3)
    body = F.substring(span, F.length(head) + 1, F.length(span) - F.length(head) - 3)
    masked = F.when(body == "", "").when(body.rlike(r"[\r\n]"), _mask_lines(body)).otherwise(F.lit(MASK))
    return F.concat(head, masked, quote)


def redact_literals(text: Column | str) -> Column:
    """Mask key blocks, quoted secrets and ``sk-`` keys; names, quotes and line ends stay."""
    text = _mask_spans(_col(text), secrets.KEY_BLOCK, _mask_lines)
    text = _mask_spans(text, secrets.TRIPLE, _mask_triple)
    text = F.regexp_replace(text, secrets.QUOTED, "$1$2[REDACTED]$2")
    return F.regexp_replace(text, secrets.API_KEY, MASK)


def redact_bare(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), secrets.BARE, "$1[REDACTED]")


def redact_source(text: Column | str, path: Column | str) -> Column:
    """Literals everywhere; bare values only where the path names a configuration file."""
    literal = redact_literals(text)
    config = F.replace(_col(path), F.lit("\\"), F.lit("/")).rlike(secrets.CONFIG_NAME)
    return F.when(config, redact_bare(literal)).otherwise(literal)


def safe_log_text(text: Column | str, maximum: int = 2048) -> Column:
    """Secrets, bearer tokens and URLs masked, then cut with a marker."""
    masked = F.regexp_replace(redact_bare(redact_literals(text)), secrets.BEARER, "Bearer [REDACTED]")
    masked = F.regexp_replace(masked, secrets.URL, "[URL_REDACTED]")
    return F.concat(F.substring(masked, 1, maximum), F.when(F.length(masked) > maximum, "…[truncated]").otherwise(""))
