"""Operations of API descriptions in JSON or YAML."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.parse import urlsplit, urlunsplit
from urllib.request import urlopen

METHODS = tuple("get post put delete options head patch trace query".split())
MOST_BYTES = 16 << 20
_METHOD = re.compile(r"[0-9A-Za-z~|`_^.*+'&%$#!-]+")


class SourceError(ValueError):
    """Why a description can't be used."""


def shown(source: str) -> str:
    """An address without user and query values."""
    parts = urlsplit(source)
    if parts.scheme not in ("http", "https"):
        return source
    host = parts.netloc.rpartition("@")
    netloc = f"***@{host[2]}" if host[1] else host[2]
    return urlunsplit(parts._replace(netloc=netloc, query="<redacted>" if parts.query else ""))


def fetch(source: str, timeout: float = 30) -> bytes:
    """A remote description: 2xx only, MOST_BYTES at most."""
    with urlopen(source, timeout=timeout) as r:  # noqa: S310
        if not 200 <= r.status < 300:
            raise SourceError(f"the server answered {r.status}")
        data = r.read(MOST_BYTES + 1)
    return data


def parse(data: bytes) -> dict:
    """The document of a JSON or YAML text of a supported version."""
    if len(data) > MOST_BYTES:
        raise SourceError("the document is larger than 16 MiB")
    try:
        text = data.decode("utf-8", "strict")
    except UnicodeDecodeError as e:
        raise SourceError("the document isn't UTF-8") from e
    try:
        document = json.loads(text)
    except RecursionError as e:
        raise SourceError("the document is nested too deeply") from e
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise SourceError("YAML can't be read here") from e
        try:
            document = yaml.safe_load(text)
        except (yaml.YAMLError, RecursionError, ValueError, TypeError) as e:
            raise SourceError(f"neither JSON nor YAML: {(str(e) or 'unreadable').splitlines()[0]}") from e
    if not isinstance(document, dict):
        raise SourceError("the document is no object")
    version = str(document.get("openapi", document.get("swagger", "")))
    if not re.match(r"(2\.0|3\.[012](\.|$))", version):
        raise SourceError(f"version '{version}' isn't supported")
    return document


def operations(document: dict) -> list[tuple[str, str]]:
    """Sorted (method, path); SourceError if one repeats."""
    found = []
    paths = document.get("paths")
    if paths is not None and not isinstance(paths, dict):
        raise SourceError("'paths' is no object")
    for path, item in (paths or {}).items():
        if not isinstance(item, dict):
            continue
        more = item.get("additionalOperations")
        if more is not None and not isinstance(more, dict):
            raise SourceError(f"'additionalOperations' of path '{path}' is no object")
        found += [(str(method).upper(), str(path)) for method in [m for m in METHODS if m in item] + list(more or {})]
    found.sort()
    for a, b in zip(found, found[1:]):
        if a == b:
            raise SourceError(f"operation '{a[0]} {a[1]}' is there more than once")
    return found


def scan(source: str, read: Callable[[], bytes]) -> dict:
    """The scan row of one description; a failure is its problem."""
    row = {"path": source, "artifact": "swagger", "units": [], "declarations": [], "problems": []}

    def problem(code: str, why: str) -> None:
        row["problems"].append({"code": code, "symbol": "operation", "message": f"API description '{shown(source)}' {why}"})

    try:
        found = operations(parse(read()))
    except (SourceError, OSError) as e:
        problem("swagger_normalize", f"can't be used: {e}")
        return row
    for method, path in found:
        if not path.startswith("/"):
            problem("swagger_bad_operation", f"has path '{path}', which doesn't start with '/'")
        elif not _METHOD.fullmatch(method):
            problem("swagger_bad_operation", f"has method '{method}', which can't form an address")
        elif re.search(r"\s", path):
            problem("swagger_bad_operation", f"has path '{path}', whose blanks can't be cited")
        else:
            target = f"{method}:{path}"
            row["units"].append({"id": f"swagger:{source}:{target}", "parent_id": None, "target": target, "identity": None, "aliases": [], "artifact": "swagger", "symbol": "operation", "path": shown(source), "line": 0, "readable": f"operation '{method} {path}'"})
    return row
