"""Scalar functions on targets, headings, tags, addresses and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULE_ENDINGS = tuple(f".{x}" for x in "ts tsx mts cts d.ts d.mts d.cts".split())


def tag_target(body: Column) -> Column:
    """First word of a tag's body."""
    return F.regexp_extract(body, "^\\s*(\\S+)", 1)


def tag_reason(body: Column) -> Column:
    """What follows the first word, trimmed."""
    return F.regexp_extract(body, "^\\s*\\S+\\s+([\\s\\S]*?)\\s*$", 1)


def plain_path(target: Column) -> Column:
    """Slashes instead of backslashes, no leading './'."""
    return F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def slug(heading: Column) -> Column:
    """Anchor of a heading: lower case, letters, numbers and '_', a '-' for each run of blanks and '-'."""
    kept = F.regexp_replace(F.lower(heading), "[^\\p{L}\\p{N}_\\-\\s\\x{85}\\p{Z}]", "")
    return F.trim(F.regexp_replace(kept, "[\\-\\s\\x{85}\\p{Z}]+", "-"), F.lit("-"))


def anchor(heading: Column) -> Column:
    """Explicit anchor at the end of a heading, else its slug."""
    named = F.regexp_extract(heading, "\\{#(\\p{Alnum}[\\p{Alnum}:._-]*)\\}\\s*$", 1)
    return F.when(named != "", named).otherwise(slug(heading))


def operation_target(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(":"), path)


def redacted(source: Column) -> Column:
    """An address without its user and without the values of its query."""
    hidden = F.regexp_replace(source, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1***@")
    return F.regexp_replace(hidden, "\\?[^#]*", "?<redacted>")


def qualified(parts: Column) -> Column:
    return F.array_join(parts, ".")


def encoded_identity(parts: Column) -> Column:
    """Parts with their byte lengths, so that no two identities read alike."""
    return F.aggregate(parts, F.lit(""), lambda a, s: F.concat(a, F.octet_length(s).cast("string"), F.lit(":"), s, F.lit(";")))


def starts_with(parts: Column, head: Column) -> Column:
    return F.slice(parts, F.lit(1), F.size(head)) == head


def package_name(specifier: Column) -> Column:
    return F.regexp_extract(specifier, "^(@[^/]+/[^/]+|[^/]+)(?:/(.*))?$", 1)


def base_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, "([^/]+?)(\\.[^./]*)?$", 1)


def location(path: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat(path, F.lit(":"), line.cast("string"))).otherwise(path)


def is_module(path: Column) -> Column:
    return F.lower(path).rlike("\\.(ts|tsx|mts|cts)$")


def in_order_of_rank(kind: Column) -> Column:
    """Headings before files before operations."""
    return F.when(kind.rlike("^h[1-4]$"), 0).when(kind == "file", 1).otherwise(2)
