"""Strict decoding of the configuration of the graph and of the documentation rule.

A configuration with any problem isn't used; all problems are told together.
"""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

from plumbline.functions.globs import GlobError, GlobSet
from plumbline.model import KINDS, MARKDOWN, OPENAPI, TYPESCRIPT

GRAPH, DOCUMENTED = "graph", "documented"
_MISSING = object()


@dataclass(frozen=True)
class Reference:
    index: int
    artifact: str
    symbols: tuple[str, ...]
    globs: GlobSet | None = None
    patterns: tuple[str, ...] = ()
    source: str | None = None
    entry: str | None = None
    package: str | None = None

    @property
    def by_entry(self) -> bool:
        """Whether the population is what an entry module exports."""
        return self.artifact == TYPESCRIPT and (self.entry is not None or (self.package is not None and self.globs is None))

    @property
    def label(self) -> str:
        what = "operations" if self.artifact == OPENAPI else ", ".join(self.symbols)
        return f"reference {self.index + 1} [{self.artifact}: {what}]"


@dataclass(frozen=True)
class Claim:
    index: int
    artifact: str
    name: str | None
    globs: GlobSet
    patterns: tuple[str, ...]
    symbols: tuple[str, ...]
    references: tuple[Reference, ...] = field(default=())

    @property
    def label(self) -> str:
        return f"claim {self.index + 1}" + (f" '{self.name}'" if self.name else "")


@dataclass(frozen=True)
class GraphConfig:
    claims: tuple[Claim, ...]

    def references(self, *artifacts: str) -> list[tuple[Claim, Reference]]:
        return [(c, r) for c in self.claims for r in c.references if not artifacts or r.artifact in artifacts]


class ConfigError(ValueError):
    """Carries every problem of a configuration."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


class _Decoder:
    def __init__(self, rule: str) -> None:
        self.rule, self.problems = rule, []

    def wrong(self, at: str, why: str) -> None:
        self.problems.append(f"{self.rule} configuration, {at}: {why}")

    def known(self, value: dict, allowed: tuple[str, ...], at: str) -> None:
        moved = {"severity": "severity is set outside the options", "sources": "claims now declare what they cite, under 'reference'", "citedBy": "the relation is declared by the citing claim, under 'reference'"}
        for name in sorted(set(value) - set(allowed)):
            hint = moved.get(name) if name == "severity" or self.rule == GRAPH else None
            self.wrong(f"{at}.{name}", hint or f"not a property; there are {', '.join(allowed)}")

    def graph(self, value: Any) -> GraphConfig:
        if not isinstance(value, dict):
            self.wrong("options", "an object with claims is required")
            return GraphConfig(())
        self.known(value, ("claims",), "options")
        claims = value.get("claims", _MISSING)
        if claims is _MISSING:
            self.wrong("claims", "missing")
        elif not isinstance(claims, list):
            self.wrong("claims", "must be an array")
        elif not claims:
            self.wrong("claims", "must not be empty")
        else:
            return GraphConfig(tuple(c for i, x in enumerate(claims) if (c := self.claim(x, i))))
        return GraphConfig(())

    def claim(self, value: Any, index: int) -> Claim | None:
        at = f"claims[{index}]"
        if not isinstance(value, dict):
            return self.wrong(at, "must be an object")
        before = len(self.problems)
        self.known(value, tuple("type name symbol files reference".split()), at)
        artifact = self.artifact(value.get("type", _MISSING), f"{at}.type", (MARKDOWN, TYPESCRIPT))
        name = value.get("name")
        if name is not None and not isinstance(name, str):
            self.wrong(f"{at}.name", "must be a string")
        globs, patterns = self.files(value.get("files", _MISSING), f"{at}.files")
        symbols = self.symbols(value.get("symbol", _MISSING), artifact, False, f"{at}.symbol")
        references = self.references(value.get("reference", _MISSING), f"{at}.reference")
        if len(self.problems) > before:
            return None
        return Claim(index, artifact, name or None, globs, patterns, symbols, references)

    def references(self, value: Any, at: str) -> tuple[Reference, ...]:
        if value is _MISSING:
            self.wrong(at, "missing")
        elif isinstance(value, dict):
            return tuple(r for r in [self.reference(value, 0, at)] if r)
        elif not isinstance(value, list):
            self.wrong(at, "must be an object or an array of objects")
        elif not value:
            self.wrong(at, "must not be empty")
        else:
            return tuple(r for i, x in enumerate(value) if (r := self.reference(x, i, f"{at}[{i}]")))
        return ()

    def reference(self, value: Any, index: int, at: str) -> Reference | None:
        if not isinstance(value, dict):
            return self.wrong(at, "must be an object")
        before = len(self.problems)
        self.known(value, tuple("type file files package symbol".split()), at)
        artifact = self.artifact(value.get("type", _MISSING), f"{at}.type", (MARKDOWN, OPENAPI, TYPESCRIPT))
        globs, patterns, source, entry, package = None, (), None, None, None
        if artifact != TYPESCRIPT and "package" in value:
            self.wrong(f"{at}.package", "packages are for TypeScript references only")
        if artifact == TYPESCRIPT:
            if "package" in value:
                package = self.package(value["package"], f"{at}.package")
            if "file" in value and "files" in value:
                self.wrong(at, "'file' and 'files' exclude each other")
            elif "file" in value:
                entry = self.relative(value["file"], f"{at}.file", "entry module")
            elif "files" in value:
                globs, patterns = self.files(value["files"], f"{at}.files")
            elif not package:
                self.wrong(at, "'file', 'files' or 'package' is required")
        elif artifact == OPENAPI:
            for name in ("files", "symbol"):
                if name in value:
                    self.wrong(f"{at}.{name}", "not for API descriptions, which have one 'file' and all its operations")
            source = self.source(value.get("file", _MISSING), f"{at}.file")
        else:
            if "file" in value:
                self.wrong(f"{at}.file", "use 'files'")
            globs, patterns = self.files(value.get("files", _MISSING), f"{at}.files")
        symbols = KINDS[OPENAPI] if artifact == OPENAPI else self.symbols(value.get("symbol", _MISSING), artifact, True, f"{at}.symbol")
        if len(self.problems) > before:
            return None
        return Reference(index, artifact, symbols, globs, patterns, source, entry, package)

    def artifact(self, value: Any, at: str, allowed: tuple[str, ...]) -> str | None:
        if value is _MISSING:
            return self.wrong(at, "missing")
        if value in allowed and isinstance(value, str):
            return value
        if value == OPENAPI:
            return self.wrong(at, "API descriptions are cited and claim nothing")
        return self.wrong(at, f"{value!r} is none of {', '.join(allowed)}")

    def files(self, value: Any, at: str) -> tuple[GlobSet | None, tuple[str, ...]]:
        if value is _MISSING:
            self.wrong(at, "missing")
        elif not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            self.wrong(at, "must be an array of patterns")
        elif not value:
            self.wrong(at, "must not be empty")
        else:
            try:
                return GlobSet(value), tuple(value)
            except GlobError as e:
                self.wrong(at, str(e))
        return None, ()

    def symbols(self, value: Any, artifact: str | None, unit: bool, at: str) -> tuple[str, ...]:
        if artifact is None:
            return ()
        allowed = KINDS[MARKDOWN] if artifact == MARKDOWN else KINDS[TYPESCRIPT]
        if value is _MISSING:
            return ("type",) if artifact == TYPESCRIPT and unit else allowed
        wanted = [value] if isinstance(value, str) else value
        if not isinstance(wanted, list) or not all(isinstance(x, str) for x in wanted):
            self.wrong(at, "must be a kind or an array of kinds")
            return ()
        if not wanted:
            self.wrong(at, "an empty array selects nothing")
        for x in wanted:
            if x not in allowed:
                self.wrong(at, f"'{x}' is no kind of {artifact}")
        return tuple(x for x in allowed if x in wanted)

    def relative(self, value: Any, at: str, what: str) -> str | None:
        if not isinstance(value, str):
            return self.wrong(at, f"must be the path of one {what}")
        if not value or value.strip() != value:
            return self.wrong(at, "must not be empty or framed by blanks")
        path = value.replace("\\", "/")
        if path.startswith("/"):
            return self.wrong(at, "must be relative")
        path = posixpath.normpath(path)
        if path in (".", "..") or path.startswith("../"):
            return self.wrong(at, "must name a file below its base")
        return path

    def package(self, value: Any, at: str) -> str | None:
        if not isinstance(value, str) or not value or value.strip() != value:
            return self.wrong(at, "must be the name of a package")
        name = value.replace("\\", "/")
        if name[0] in "./":
            return self.wrong(at, f"'{value}' is a path")
        parts, need = name.split("/"), 2 if name[0] == "@" else 1
        if len(parts) != need:
            return self.wrong(at, f"'{value}' " + ("goes into a package" if len(parts) > need else "is half a scoped name"))
        return name

    def source(self, value: Any, at: str) -> str | None:
        if value is _MISSING:
            return self.wrong(at, "missing")
        if isinstance(value, str) and value == value.strip() and value:
            try:
                parts = urlsplit(value)
            except ValueError as e:
                return self.wrong(at, f"no address: {e}")
            if parts.scheme:
                if parts.scheme not in ("http", "https"):
                    return self.wrong(at, f"scheme '{parts.scheme}' isn't http or https")
                if not parts.netloc:
                    return self.wrong(at, "an address without host")
                if parts.fragment:
                    return self.wrong(at, "an address with a fragment")
                return value
            if "://" in value:
                return self.wrong(at, "no address")
        return self.relative(value, at, "API description")


def decode_graph(value: str | dict) -> GraphConfig:
    """The configuration of a JSON text or decoded object; ConfigError with all problems."""
    d = _Decoder(GRAPH)
    try:
        value = json.loads(value) if isinstance(value, str) else value
    except ValueError as e:
        raise ConfigError([f"{GRAPH} configuration: {e}"]) from e
    config = d.graph(value)
    if d.problems:
        raise ConfigError(d.problems)
    return config


def decode_documented(value: dict | None) -> tuple[str, ...]:
    """The kinds that need documentation, all by default."""
    d = _Decoder(DOCUMENTED)
    if value is None:
        return KINDS[TYPESCRIPT]
    if not isinstance(value, dict):
        raise ConfigError([f"{DOCUMENTED} configuration: must be an object"])
    d.known(value, ("symbol",), "options")
    symbols = d.symbols(value.get("symbol", _MISSING), TYPESCRIPT, False, "symbol")
    if d.problems:
        raise ConfigError(d.problems)
    return symbols
