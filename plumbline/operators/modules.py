"""Module names to files, and what an entry module exports."""

from __future__ import annotations

import json
import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.functions.text import MODULE_ENDINGS
from plumbline.operators.resolve import first_match

_PACKAGE = re.compile(r"(@[^/]+/[^/]+|[^@/][^/]*)(?:/(.*))?")


def candidates_of(stem: str) -> list[str]:
    """The files that a module path may mean, in order."""
    bare = re.sub(r"\.[mc]?js$", "", stem)
    return [stem, *[bare + e for e in MODULE_ENDINGS], *[posixpath.join(bare, "index" + e) for e in MODULE_ENDINGS]]


def _condition(entry: object) -> str | None:
    if not isinstance(entry, dict):
        return None
    if "types" in entry:
        return entry["types"] if isinstance(entry["types"], str) else _condition(entry["types"])
    return next((e for c in ("import", "default") if (e := _condition(entry.get(c)))), None)


def package_entry(manifest: str | None, subpath: str | None) -> str | None:
    """Where a package's manifest puts the types of its root or of a path in it."""
    try:
        m = json.loads(manifest) if manifest else None
    except ValueError:
        m = None
    if not isinstance(m, dict):
        return None
    key, exports = f"./{subpath}" if subpath else ".", m.get("exports")
    if isinstance(exports, dict):
        if "." in exports or subpath:
            found = _condition(exports.get(key))
        else:
            found = _condition(exports)
        if found:
            return found
    if subpath:
        return None
    versions = m.get("typesVersions")
    if isinstance(versions, dict):
        for v in sorted(versions):
            entries = versions[v].get("*") if isinstance(versions[v], dict) else None
            if entries and isinstance(entries, list):
                return entries[0]
    return next((m[f] for f in ("types", "typings") if isinstance(m.get(f), str) and m[f]), None)


def package_of(specifier: str) -> tuple[str, str | None] | None:
    m = None if specifier[:1] in (".", "/") else _PACKAGE.fullmatch(specifier)
    return (m[1], m[2] or None) if m else None


def module_names(source: str | None, specifier: str, manifest: str | None) -> list[str]:
    """Files that a specifier may mean where it is written, in order."""
    if specifier.startswith(("./", "../")):
        return candidates_of(posixpath.normpath(posixpath.join(posixpath.dirname(source or ""), specifier)))
    package = package_of(specifier)
    if not package:
        return []
    entry = package_entry(manifest, package[1]) or package[1]
    return candidates_of(posixpath.normpath(posixpath.join("node_modules", package[0], entry))) if entry else []


def manifests(files: DataFrame) -> DataFrame:
    """(package, manifest) of the installed packages."""
    own = files.filter(F.col("path").rlike("^node_modules/(@[^/]+/)?[^/]+/package\\.json$"))
    return own.select(F.regexp_extract("path", "^node_modules/(.*)/package\\.json$", 1).alias("package"), F.decode("content", "UTF-8").alias("manifest"))


def resolve_modules(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(from, specifier, module) of the distinct requests (from, specifier) that lead to a file."""

    @F.pandas_udf("array<string>")
    def names(source: pd.Series, specifier: pd.Series, manifest: pd.Series) -> pd.Series:
        return pd.Series([module_names(a, b, c if isinstance(c, str) else None) for a, b, c in zip(source, specifier, manifest)])

    asked = requests.select("from", "specifier").distinct()
    package = F.when(~F.col("specifier").rlike("^[./]"), F.regexp_extract("specifier", "^(@[^/]+/[^/]+|[^/]+)", 1))
    listed = asked.withColumn("package", package).join(manifests(files), "package", "left").select("from", "specifier", F.posexplode(names("from", "specifier", "manifest")).alias("ord", "candidate"))
    return first_match(listed, files.select(F.col("path").alias("candidate")), ["from", "specifier"]).select("from", "specifier", F.col("candidate").alias("module"))


def entry_exports(entries: DataFrame, exports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entry, address, path, local, trail_order): what each entry module exposes, and under which address.

    A state is a module with an address so far; one that asks for a single name
    remembers it. Every state is expanded once, so a cycle ends, and barrels
    that share modules don't multiply. A name that several stars could give is
    the first one in the order of the exports.
    """
    edges = exports.join(resolved, (F.col("file") == resolved["from"]) & exports["specifier"].eqNullSafe(resolved["specifier"]), "left").select("file", "public", "local", exports["specifier"].alias("spec"), "imported", "is_namespace", "ord", "module")
    edges = cut(edges)
    no_order = F.array().cast("array<int>")
    front = cut(entries.select("entry", F.col("entry").alias("at"), F.array().cast("array<string>").alias("address"), F.lit(None).cast("string").alias("wanted"), no_order.alias("order"), F.array("entry").alias("trail"), F.lit(None).cast("string").alias("origin")).distinct())
    seen = front
    reached = None
    while True:  # no trail holds a module twice, so it ends
        step = front.join(edges, front["at"] == edges["file"])
        name_fits = F.col("wanted").isNull() | (F.col("public") == F.col("wanted"))
        longer = F.concat("order", F.array("ord"))
        here = F.when(F.col("wanted").isNull(), F.concat("address", F.array("public"))).otherwise(F.col("address"))
        found = step.filter(F.col("spec").isNull() & name_fits).select("entry", here.alias("address"), F.col("at").alias("path"), "local", longer.alias("trail_order"), "origin")
        reached = cut(found if reached is None else reached.unionByName(found))
        onward = step.filter(F.col("spec").isNotNull() & F.col("module").isNotNull() & ~F.array_contains("trail", F.col("module")))
        star = F.col("imported").isNull() & ~F.col("is_namespace")
        one_name = F.col("imported").isNotNull() & name_fits
        whole = F.col("is_namespace") & F.col("wanted").isNull()
        origin = F.coalesce("origin", F.when(one_name, F.concat_ws("\u0001", "entry", F.array_join(F.transform(longer, lambda x: x.cast("string")), ","), F.array_join("trail", "\u0002"))))
        nxt = onward.filter(star | one_name | whole).select(
            "entry",
            F.col("module").alias("at"),
            F.when(star | F.col("wanted").isNotNull(), F.col("address")).otherwise(F.concat("address", F.array("public"))).alias("address"),
            F.when(one_name, F.col("imported")).otherwise(F.col("wanted")).alias("wanted"),
            longer.alias("order"),
            F.concat("trail", F.array("module")).alias("trail"),
            origin.alias("origin"),
        )
        state = ["entry", "at", "address", "wanted", "origin"]
        first = nxt.groupBy(*state).agg(F.min(F.struct("order", "trail")).alias("_m")).select(*state, "_m.*")
        known = seen.select(*[F.col(c).alias(f"_{c}") for c in state])
        same = F.lit(True)
        for c in state:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        front = cut(first.join(known, same, "left_anti").select(*front.columns))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    single = reached.filter("origin is not null").groupBy("entry", "origin").agg(F.min_by(F.struct("address", "path", "local", "trail_order"), "trail_order").alias("_r")).select("entry", "_r.*")
    return reached.filter("origin is null").drop("origin").unionByName(single)
