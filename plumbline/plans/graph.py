"""The graph rule: which units are acknowledged by whom, and what is wrong.

Every step is a relation keyed by claim and reference; messages are made last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import model
from plumbline.config import Claim, ConfigError, GraphConfig, Reference, decode_graph
from plumbline.functions.globs import GlobSet, glob_table, members
from plumbline.functions.lineage import cut
from plumbline.functions.text import is_module, location, plain_path, redacted, starts_with
from plumbline.operators import coverage
from plumbline.operators.closure import ancestor_closure, prefixes
from plumbline.operators.modules import candidates_of, entry_exports, resolve_modules
from plumbline.operators.resolve import cardinality, completeness, only_in, stage_of, with_fallback
from plumbline.sources import openapi
from plumbline.sources.inventory import flat, folders_of, in_program, project_scan, read_tree, root_problem

CR = ["claim_idx", "ref_idx"]


@dataclass
class Graph:
    """The relations of one check."""

    config: GraphConfig
    claims: DataFrame
    references: DataFrame
    scan: DataFrame
    claim_declarations: DataFrame
    reference_units: DataFrame
    scope_units: DataFrame
    resolved: DataFrame
    cover: DataFrame
    acknowledged: DataFrame
    missing: DataFrame
    diagnostics: DataFrame
    words: tuple[str, str] = model.TAGS


def config_tables(spark: SparkSession, config: GraphConfig) -> tuple[DataFrame, DataFrame]:
    claims = spark.createDataFrame([(c.index, c.artifact, c.name, list(c.symbols), c.label) for c in config.claims], model.CLAIMS)
    references = spark.createDataFrame(
        [(c.index, r.index, r.artifact, r.source, r.entry, r.package, r.by_entry, list(r.symbols), r.label) for c, r in config.references()],
        model.REFERENCES,
    )
    return claims, F.broadcast(references)


def _problem(rows: DataFrame, code: str | Column, message: Column, claim: Column | None = None, ref: Column | None = None, path: Column | None = None, line: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (claim if claim is not None else none).cast("int").alias("claim_idx"),
        (ref if ref is not None else none).cast("int").alias("ref_idx"),
        (path if path is not None else none).cast("string").alias("path"),
        (line if line is not None else none).cast("int").alias("line"),
        message.alias("message"),
    )


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _literal(value: str | tuple[str, ...]) -> Column:
    return F.lit(value) if isinstance(value, str) else F.array(*map(F.lit, value))


class _Build:
    def __init__(self, spark: SparkSession, files: DataFrame, config: GraphConfig, program: GlobSet | None, fetch: Callable[[str], bytes], words: tuple[str, str]) -> None:
        self.spark, self.config, self.words = spark, config, words
        self.files = files
        self.program = program
        self.claims, self.references = config_tables(spark, config)
        self.scan = project_scan(spark, files, config, program, fetch, words)
        self.units = flat(self.scan, "units")
        self.problems: list[DataFrame] = []
        self.label = F.concat_ws(" ", "claim_label", "ref_label")

    def _of_claim(self, value: Callable[[Claim], str | tuple[str, ...]]) -> Column:
        """What the configuration says of the claim of a row: a configuration is small, so it is part of the plan and needs no join."""
        return F.create_map(*[x for c in self.config.claims for x in (F.lit(c.index), _literal(value(c)))])[F.col("claim_idx")]

    def _of_reference(self, value: Callable[[Reference], str | tuple[str, ...]]) -> Column:
        pairs = [x for c, r in self.config.references() for x in (F.lit(f"{c.index},{r.index}"), _literal(value(r)))]
        return F.create_map(*pairs)[F.concat_ws(",", "claim_idx", "ref_idx")]

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """rows with the labels of their claim and, if they have one, reference."""
        more = {"claim_label": self._of_claim(lambda c: c.label), "claim_artifact": self._of_claim(lambda c: c.artifact), "host_symbols": self._of_claim(lambda c: c.symbols)}
        if "ref_idx" in rows.columns:
            more |= {"ref_label": self._of_reference(lambda r: r.label), "ref_artifact": self._of_reference(lambda r: r.artifact)}
        return rows.withColumns(more)

    def _selected(self, rows: DataFrame) -> DataFrame:
        """The rows whose symbol their reference selects; '*' is any."""
        return rows.filter((F.col("symbol") == "*") | F.array_contains(self._of_reference(lambda r: r.symbols), F.col("symbol")))

    def _program_paths(self) -> DataFrame:
        """(path) of the modules that make up the program."""
        own = self.scan.filter(F.col("artifact") == model.TYPESCRIPT).select("path").filter(in_program(F.col("path")))
        return members(own, glob_table(self.spark, {"program": self.program}), F.col("path")).select("path") if self.program else own

    def claim_paths(self) -> DataFrame:
        """(claim_idx, path)"""
        paths = self.scan.select("path", "artifact").filter(F.col("artifact") == model.MARKDOWN).unionByName(self._program_paths().withColumn("artifact", F.lit(model.TYPESCRIPT)))
        self.program_and_docs = paths
        globs = glob_table(self.spark, {str(c.index): c.globs for c in self.config.claims})
        hit = members(paths, globs, F.col("path")).withColumn("claim_idx", F.col("owner").cast("int"))
        found = hit.join(F.broadcast(self.claims.select("claim_idx", "artifact")), ["claim_idx", "artifact"]).select("claim_idx", "path")
        empty = self._labelled(self.claims.select("claim_idx").join(found, "claim_idx", "left_anti"))
        self.problems.append(_problem(empty, "claim_no_files", _say(F.col("claim_label"), " has no files that match ", self._of_claim(lambda c: ", ".join(c.patterns))), F.col("claim_idx")))
        return found

    def reference_paths(self) -> DataFrame:
        """(claim_idx, ref_idx, path) of the populations that patterns or a source select."""
        parts = []
        plain = {f"{c.index},{r.index}": r.globs for c, r in self.config.references() if r.globs and not r.package}
        if plain:
            hit = members(self.program_and_docs, glob_table(self.spark, plain), F.col("path"))
            parts.append(self._split(hit).join(self.references.select(*CR, "artifact"), [*CR, "artifact"]).select(*CR, "path"))
        packaged = {f"{c.index},{r.index}": r.globs for c, r in self.config.references() if r.globs and r.package}
        if packaged:
            inner = F.col("path").startswith("node_modules/") & is_module(F.col("path"))
            refs = self.references.filter("package is not null and not by_entry").select(*CR, "package")
            own = self.scan.filter(inner).select("path").join(F.broadcast(refs), F.col("path").startswith(F.concat(F.lit("node_modules/"), "package", F.lit("/"))))
            relative = own.withColumn("relative", F.expr("substring(path, length(package) + 15)")).select(F.concat_ws(",", "claim_idx", "ref_idx").alias("own"), "path", "relative")
            hit = members(relative, glob_table(self.spark, packaged), F.col("relative")).filter("owner = own")
            parts.append(self._split(hit).select(*CR, "path"))
        if self.config.references(model.OPENAPI):
            parts.append(self.references.filter(F.col("artifact") == model.OPENAPI).select(*CR, F.col("source").alias("path")))
        if not parts:
            return self.spark.createDataFrame([], "claim_idx int, ref_idx int, path string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out.distinct())

    @staticmethod
    def _split(hit: DataFrame) -> DataFrame:
        two = F.split("owner", ",")
        return hit.select("*", two[0].cast("int").alias("claim_idx"), two[1].cast("int").alias("ref_idx"))

    def populations(self) -> tuple[DataFrame, DataFrame]:
        """(units with their addresses, scopes with the units below them) of every reference."""
        paths = self.reference_paths()
        held = paths.join(self.units.withColumnRenamed("path", "shown"), paths["path"] == F.col("file")).drop("file")
        held = cut(held.dropDuplicates([*CR, "id"]))
        chosen = self._selected(held)
        closed = ancestor_closure(held.select(*CR, "id", "parent_id"), *CR)
        scopes = closed.join(chosen.select(*CR, "id"), [*CR, "id"]).select(*CR, "scope_id", F.col("id").alias("unit_id"), F.lit(0).alias("turn"))
        addressed = held.join(scopes.select(*CR, F.col("scope_id").alias("id")).distinct(), [*CR, "id"], "left_semi").withColumn("owner", F.col("path"))
        by_globs = self.references.filter("not by_entry")
        none = by_globs.join(paths, CR, "left_anti")
        lost = _problem(self._labelled(none.select(*CR)), "ref_no_files", _say(self.label, " has no files", self._of_reference(lambda r: f" that match {', '.join(r.patterns)}" if r.patterns else "")), F.col("claim_idx"), F.col("ref_idx"))
        self.problems.append(self._of_packages(lost))
        flawed = paths.join(flat(self.scan, "problems"), paths["path"] == F.col("file"))
        flawed = self._selected(flawed).select(*CR).distinct()
        hollow = paths.groupBy(*CR).agg(F.count("*").alias("n")).join(chosen.select(*CR).distinct(), CR, "left_anti").join(flawed, CR, "left_anti")
        hollow = _problem(self._labelled(hollow), "ref_no_units", _say(self.label, " has ", F.col("n").cast("string"), " file(s) without a selected unit"), F.col("claim_idx"), F.col("ref_idx"))
        self.problems.append(self._of_packages(hollow))
        self.paths = paths
        chosen = chosen.withColumn("owner", F.col("path"))
        if any(r.by_entry for _, r in self.config.references()):
            more, more_scopes, entries = self.entries()
            chosen, scopes, addressed = chosen.unionByName(more, True), scopes.unionByName(more_scopes), addressed.unionByName(more, True)
            self.paths = paths.unionByName(entries)
        self.addressed = addressed
        return cut(chosen), cut(scopes)

    def _of_packages(self, problems: DataFrame) -> DataFrame:
        """The problems, with codes of their own where the reference is to a package."""
        packaged = [(c.index, r.index, "package") for c, r in self.config.references() if r.package]
        if not packaged:
            return problems
        named = problems.join(F.broadcast(self.spark.createDataFrame(packaged, "claim_idx int, ref_idx int, _stem string")), CR, "left")
        code = F.regexp_replace("code", "^(ref|entry)_", "")
        stem = F.when(F.col("code").startswith("entry_"), F.lit("package_entry_")).otherwise(F.lit("package_"))
        return named.withColumn("code", F.when(F.col("_stem").isNull(), F.col("code")).otherwise(F.concat(stem, code))).select("code", *CR, "path", "line", "message")

    def modules(self) -> DataFrame:
        """(from, specifier, module) of all imports and re-exports."""
        if not hasattr(self, "_modules"):
            asked = flat(self.scan, "imports").select(F.col("file").alias("from"), "specifier").unionByName(flat(self.scan, "exports").filter("specifier is not null").select(F.col("file").alias("from"), "specifier"))
            self._modules = cut(resolve_modules(asked, self.files))
        return self._modules

    def entries(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Units, scopes and entry paths of the populations that an entry module exports."""
        asked, bare = [], []
        for c, r in self.config.references(model.TYPESCRIPT):
            if not r.by_entry:
                continue
            if r.entry:
                stem = f"node_modules/{r.package}/{r.entry}" if r.package else r.entry
                asked += [(c.index, r.index, name, k) for k, name in enumerate(candidates_of(stem))]
            else:
                bare.append((c.index, r.index, r.package))
        named = self.spark.createDataFrame(asked, "claim_idx int, ref_idx int, candidate string, ord int")
        there = self.files.select(F.col("path").alias("candidate")).distinct()
        found = named.join(there, "candidate", "left_semi").groupBy(*CR).agg(F.min_by("candidate", "ord").alias("entry"))
        packages = self.spark.createDataFrame(bare, "claim_idx int, ref_idx int, specifier string").withColumn("from", F.lit(""))
        located = resolve_modules(packages, self.files).select("specifier", F.col("module").alias("entry"))
        found = cut(found.unionByName(packages.join(located, "specifier").select(*CR, "entry")))
        lost = self.references.filter("by_entry").join(found, CR, "left_anti")
        lost = _problem(self._labelled(lost.select(*CR)), "entry_missing", _say(self.label, " has no entry module"), F.col("claim_idx"), F.col("ref_idx"))
        self.problems.append(self._of_packages(lost))
        reached = cut(entry_exports(found.select("entry"), flat(self.scan, "exports"), self.modules()))
        owner = F.split("local", "\\.")
        whole = reached.withColumn("own", owner).join(self.units.withColumnRenamed("path", "shown"), (F.col("path") == F.col("file")) & (F.try_element_at("identity", F.lit(1)) == F.try_element_at("own", F.lit(1))))
        whole = whole.filter(starts_with(F.col("identity"), F.col("own"))).withColumn("full", F.concat("address", F.expr("slice(identity, size(own) + 1, 1000000)")))
        per = found.join(whole, "entry").groupBy(*CR, "entry", "id").agg(
            F.first(F.struct("parent_id", "artifact", "symbol", "path", "shown", "line", "readable")).alias("_u"),
            F.min(F.struct(F.size("full").alias("n"), F.col("trail_order"), F.col("full"))).alias("_first"),
            F.array_sort(F.collect_set(F.array_join("full", "."))).alias("_all"),
        )
        target = F.array_join("_first.full", ".")
        units = per.select(*CR, F.col("entry").alias("owner"), "id", "_u.*", target.alias("target"), F.col("_first.full").alias("identity"), F.array_except("_all", F.array(target)).alias("aliases"))
        units = cut(self._selected(units))
        hollow = found.join(units.select(*CR).distinct(), CR, "left_anti")
        self.problems.append(_problem(self._labelled(hollow), "entry_no_units", _say(self.label, ": entry '", F.col("entry"), "' leads to no selected unit"), F.col("claim_idx"), F.col("ref_idx")))
        inner = units.select(*CR, F.col("id").alias("unit_id"), F.explode(prefixes(F.col("identity"))).alias("above"))
        below = inner.join(units.select(*CR, F.col("id").alias("scope_id"), F.col("identity").alias("above")), [*CR, "above"]).filter("scope_id <> unit_id").select(*CR, "scope_id", "unit_id", F.lit(1).alias("turn"))
        scopes = units.select(*CR, F.col("id").alias("scope_id"), F.col("id").alias("unit_id"), F.lit(0).alias("turn")).unionByName(below.distinct())
        return units, scopes, found.select(*CR, F.col("entry").alias("path"))

    def resolve(self, declared: DataFrame) -> DataFrame:
        """(decl_id, scope_id) of the declarations that mean exactly one unit; the others are problems."""
        where = location(F.col("path"), F.col("line"))
        d = declared.dropDuplicates(["id"]).withColumnRenamed("id", "decl_id")
        sound = (F.col("target") != "") & (F.col("reason") != "")
        self.problems.append(_problem(d.filter(~sound), "malformed", _say("@", F.col("tag"), " at ", where, " lacks a target or a reason"), path=F.col("path"), line=F.col("line")))
        d = d.filter(sound)
        a = self.addressed
        every = F.explode(F.concat(F.array("target"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("address")
        unit_place = location(F.coalesce("shown", "path"), F.col("line"))
        targets = cut(a.select(every, F.col("id").alias("unit_id"), "artifact", "owner", _say(F.col("readable"), " at ", unit_place).alias("described")).distinct())
        links = self.links(d.filter("is_link"), targets, where)
        plain = d.filter("not is_link")
        ts = targets.filter(F.col("artifact") == model.TYPESCRIPT).select(F.col("address").alias("target")).distinct()
        md = targets.filter(F.col("artifact") == model.MARKDOWN)
        mine = plain.filter(F.col("artifact") == model.TYPESCRIPT)
        bare = only_in(mine, ts, md.select(F.col("address").alias("target")), "target")
        self.problems.append(_problem(bare, "unbraced", _say("'", F.col("target"), "' at ", where, " names a TypeScript symbol: write it as {@link ", F.col("target"), "} and import it"), path=F.col("path"), line=F.col("line")))
        rest = plain.join(bare.select("decl_id"), "decl_id", "left_anti")
        known = ["unit_id", "described"]
        matches = with_fallback(rest, targets.select(F.col("address").alias("target"), *known), "target", "decl_id", plain_path(F.col("target")), md.select(F.col("address").alias("target"), *known))
        counted = cardinality(rest, matches, ["decl_id"], "unit_id", F.col("described"))
        lost, many = counted.filter("n = 0"), counted.filter("n > 1")
        self.problems.append(_problem(lost, "unresolved", _say("'", F.col("target"), "' at ", where, " is no known unit"), path=F.col("path"), line=F.col("line")))
        self.problems.append(_problem(many, "ambiguous", _say("'", F.col("target"), "' at ", where, " could be ", F.col("matches")), path=F.col("path"), line=F.col("line")))
        good = counted.filter("n = 1").select("decl_id", F.col("unit").alias("scope_id"))
        return good.unionByName(links)

    def links(self, d: DataFrame, targets: DataFrame, where: Column) -> DataFrame:
        """Inline links, through the imports of the file that holds them; the first step that fails is told."""
        foreign = d.filter(F.col("artifact") != model.TYPESCRIPT)
        at = {"path": F.col("path"), "line": F.col("line")}
        shown = _say("{@link ", F.col("target"), "} at ", where)
        self.problems.append(_problem(foreign, "link_not_typescript", _say(shown, ": only TypeScript has imports to resolve a link"), **at))
        own = d.filter(F.col("artifact") == model.TYPESCRIPT).withColumn("_parts", F.split("target", "\\.")).withColumn("_head", F.col("_parts")[0])
        if own.isEmpty():
            return d.sparkSession.createDataFrame([], "decl_id string, scope_id string")
        imports = flat(self.scan, "imports").withColumnRenamed("file", "_file")
        bound = own.join(imports, (F.col("path") == F.col("_file")) & (F.col("_head") == F.col("local")), "left")
        found = bound.join(self.modules(), (F.col("path") == F.col("from")) & bound["specifier"].eqNullSafe(self.modules()["specifier"]), "left").drop(self.modules()["specifier"])
        rest = F.expr("slice(_parts, 2, 1000000)")
        name = F.array_join(F.when(F.col("is_namespace"), rest).otherwise(F.concat(F.array("imported"), rest)), ".")
        stage = stage_of([("unimported", F.col("local").isNull()), ("unresolved_module", F.col("module").isNull()), ("incomplete", F.col("_name") == "")], "ready")
        staged = cut(found.withColumn("_name", name).withColumn("_stage", stage))
        told = (
            F.when(F.col("_stage") == "unimported", _say(shown, ": '", F.col("_head"), "' isn't imported"))
            .when(F.col("_stage") == "unresolved_module", _say(shown, ": module '", F.col("specifier"), "' leads to no file"))
            .otherwise(_say(shown, " names a module and no unit in it"))
        )
        failed = _problem(staged.filter("_stage <> 'ready'"), F.col("_stage"), told, **at)
        self.problems.append(failed)
        ready = staged.filter("_stage = 'ready'")
        scoped = targets.filter(F.col("artifact") == model.TYPESCRIPT)
        candidates = ready.join(scoped, (F.col("module") == F.col("owner")) & (F.col("_name") == F.col("address"))).select("decl_id", "unit_id", "described")
        counted = cardinality(ready, candidates, ["decl_id"], "unit_id", F.col("described"))
        self.problems.append(_problem(counted.filter("n = 0"), "unreachable", _say(shown, ": '", F.col("module"), "' has no selected unit '", F.col("_name"), "'"), **at))
        self.problems.append(_problem(counted.filter("n > 1"), "ambiguous_in_module", _say(shown, ": '", F.col("module"), "' has ", F.col("matches")), **at))
        return counted.filter("n = 1").select("decl_id", F.col("unit").alias("scope_id"))

    def run(self) -> Graph:
        claim_paths = self.claimed = self.claim_paths()
        declared = flat(self.scan, "declarations").drop("file")
        claim_decl = cut(claim_paths.join(declared, "path"))
        chosen, scopes = self.populations()
        resolved = self.resolve(claim_decl.drop("claim_idx"))
        active = chosen.select(*CR).distinct().join(claim_paths.select("claim_idx").distinct(), "claim_idx", "left_semi")
        cover = claim_decl.select("claim_idx", F.col("id").alias("decl_id"), "tag", F.col("target").alias("cited"), "hosts", "path", "line", "seq").join(resolved, "decl_id").withColumn("host_symbols", self._of_claim(lambda c: c.symbols))
        cover = coverage.expand(cover, scopes, ["claim_idx", "scope_id"])
        inside, outside = coverage.out_of_scope(cut(cover), F.col("hosts"), F.col("host_symbols"))
        where = location(F.col("path"), F.col("line"))
        host = F.when(F.size("hosts") > 0, F.array_join("hosts", ", ")).otherwise("none")
        stray = self._labelled(outside.select("claim_idx", "tag", "path", "line", "hosts").distinct())
        self.problems.append(_problem(stray, "out_of_scope", _say("@", F.col("tag"), " at ", where, " isn't on a host that ", F.col("claim_label"), " selects: ", host, " is none of ", F.array_join("host_symbols", ", ")), F.col("claim_idx"), path=F.col("path"), line=F.col("line")))
        unit_keys, order = [*CR, "unit_id"], ["path", "seq", "decl_id"]
        ack = cut(coverage.first_of(inside, unit_keys, order, ["tag", "line"]))
        about = chosen.select(*CR, F.col("id").alias("unit_id"), F.col("target"), "symbol", F.col("artifact").alias("unit_artifact"), F.coalesce("shown", "path").alias("unit_path"), F.col("line").alias("unit_line"), "readable")
        later = inside.join(ack, unit_keys).filter("decl_id <> first_decl_id").join(about.select(*unit_keys, "target"), unit_keys)
        overlaps = later.groupBy(*CR, "decl_id", "path", "line", "cited").agg(F.min(F.struct("turn", "target", "unit_id", "first_path", "first_line")).alias("_o")).select("*", "_o.target", "_o.first_path", "_o.first_line")
        first_place = location(F.col("first_path"), F.col("first_line"))
        self.problems.append(_problem(self._labelled(overlaps), "duplicate", _say("'", F.col("target"), "' in ", self.label, " is acknowledged again at ", where, " by '", F.col("cited"), "', first at ", first_place), F.col("claim_idx"), F.col("ref_idx"), F.col("path"), F.col("line")))
        missing = coverage.missing(about.join(active, CR, "left_semi"), ack, unit_keys)
        both_ts = (F.col("unit_artifact") == model.TYPESCRIPT) & (F.col("claim_artifact") == model.TYPESCRIPT)
        form = F.when(both_ts, _say("{@link ", F.col("target"), "}")).otherwise(F.col("target"))
        self.problems.append(_problem(self._labelled(missing), "missing", _say("'", F.col("target"), "' (", F.col("readable"), " at ", location(F.col("unit_path"), F.col("unit_line")), ") isn't acknowledged in ", self.label, f": cite '@{self.words[0]} ", form, f" <reason>', or '@{self.words[1]} ", form, " <reason>'"), F.col("claim_idx"), F.col("ref_idx"), F.col("unit_path"), F.col("unit_line")))
        self.scan_problems()
        found = self.problems[0]
        for p in self.problems[1:]:
            found = found.unionByName(p)
        diagnostics = cut(coverage.distinct_diagnostics(found))
        return Graph(self.config, self.claims, self.references, self.scan, claim_decl, chosen, scopes, resolved, inside, ack, missing, diagnostics, self.words)

    def scan_problems(self) -> None:
        """What the scanners couldn't use, as far as a claim or reference selects it."""
        flaws = flat(self.scan, "problems", "artifact")
        api = flaws.filter(F.col("artifact") == model.OPENAPI)
        self.problems.append(self._coded(api))
        sources = sorted({r.source for _, r in self.config.references(model.OPENAPI)})
        if sources:
            asked = self.spark.createDataFrame([(s,) for s in sources], "path string")
            states = completeness(asked, self.scan.filter(F.col("artifact") == model.OPENAPI).select("path"), "path")
            for status, code, text in (("no result", "swagger_no_result", "gave no result"), ("repeated", "swagger_repeated", "gave several results"), ("not configured", "swagger_unconfigured", "gave a result that no reference asks for")):
                self.problems.append(_problem(states.filter(F.col("status") == status), code, _say("API description '", redacted(F.col("path")), f"' {text}"), path=redacted(F.col("path"))))
        wanted = self.paths.select(*CR, F.col("path").alias("file"))
        md = self._selected(flaws.filter(F.col("artifact") == model.MARKDOWN).join(wanted, "file"))
        self.problems.append(self._coded(md))
        read = self.claimed.select("path").unionByName(self.paths.select("path")).select(F.col("path").alias("file")).distinct()
        broken = flaws.filter(F.col("code").isin("md_unreadable", "ts_unreadable")).join(read, "file", "left_semi")
        self.problems.append(self._coded(broken))

    @staticmethod
    def _coded(flaws: DataFrame) -> DataFrame:
        return flaws.select(F.col("code"), *[F.lit(None).cast("int").alias(c) for c in CR], F.col("file").alias("path"), F.lit(None).cast("int").alias("line"), "message")


def check_files(spark: SparkSession, files: DataFrame, config: GraphConfig | dict | str, program: list[str] | None = None, fetch: Callable[[str], bytes] = openapi.fetch, words: tuple[str, str] = model.TAGS) -> Graph:
    """The graph rule over files (path, content); ConfigError if the configuration can't be used. words: the names of the two tags."""
    config = config if isinstance(config, GraphConfig) else decode_graph(config)
    return _Build(spark, files, config, GlobSet(program) if program else None, fetch, words).run()


def check_tree(spark: SparkSession, root: str, config: GraphConfig | dict | str, program: list[str] | None = None, fetch: Callable[[str], bytes] = openapi.fetch, words: tuple[str, str] = model.TAGS) -> Graph:
    """The graph rule over the files below a folder, of which only what may be asked for is listed.

    A folder that isn't there or can't be read is the only diagnostic.
    """
    config = config if isinstance(config, GraphConfig) else decode_graph(config)
    globs = GlobSet(program) if program else None
    if wrong := root_problem(spark, root):
        graph = check_files(spark, spark.createDataFrame([], model.FILES), config, program, lambda _: b"", words)
        graph.diagnostics = spark.createDataFrame([(wrong[0], None, None, root, None, wrong[1])], graph.diagnostics.schema)
        return graph
    return check_files(spark, read_tree(spark, root, folders_of(config, globs)), config, program, fetch, words)


def report(graph: Graph) -> DataFrame:
    """Messages in order."""
    return graph.diagnostics.select("message").orderBy("message")


def config_messages(config: dict | str) -> list[str]:
    """Problems of a configuration, none if it can be used."""
    try:
        decode_graph(config)
    except ConfigError as e:
        return e.problems
    return []
