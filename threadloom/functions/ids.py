"""Stable ids of sources, concepts and boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.url import strip_blanks


def concept_name(c: Column) -> Column:
    """Lower, single blanks, only letters, digits, _ - / + . # and blanks."""
    s = F.regexp_replace(F.lower(strip_blanks(c)), r"[\s\u00a0]+", " ")
    return strip_blanks(F.regexp_replace(s, r"[^\p{L}\p{N}_\s\-/+.#]", ""))


def source_id(url: Column) -> Column:
    return F.concat(F.lit("source_"), F.sha1(url))


def concept_id(kind: Column, name: Column) -> Column:
    """Null where nothing remains of the name."""
    k = F.coalesce(F.nullif(F.lower(strip_blanks(kind)), F.lit("")), F.lit("concept"))
    n = concept_name(name)
    return F.when(n != "", F.concat(F.lit("concept_"), k, F.lit("_"), F.left(F.sha1(F.concat(k, F.lit("||"), n)), F.lit(12))))


def micro_id(source: Column, text: Column) -> Column:
    return F.concat(F.lit("micro_"), source, F.lit("_"), F.left(F.sha1(strip_blanks(text)), F.lit(12)))


def scoped_id(source: Column, node: Column) -> Column:
    return F.concat(F.lit("srcnode::"), source, F.lit("::"), node)


def confidence(c: Column) -> Column:
    """A number in [0, 1] or null (text that is no number, NaN, outside)."""
    x = c.try_cast("double")
    return F.when(x.between(0.0, 1.0) & ~F.isnan(x), x)


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    # Types by extension.
    known = {"jsonl": "application/x-ndjson", "json": "application/json", "csv": "text/csv", "md": "text/markdown", "txt": "text/plain", "canvas": "application/json"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), ext), F.lit("application/octet-stream"))
