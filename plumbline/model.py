"""Relations of a project, as DDL strings.

Absent is NULL throughout. ``scan`` rows are what a scanner gives for one file;
``plumbline.sources.inventory`` turns them into flat relations.
"""

from __future__ import annotations

MARKDOWN, OPENAPI, TYPESCRIPT = "markdown", "swagger", "typescript"
KINDS = {MARKDOWN: tuple("file h1 h2 h3 h4".split()), TYPESCRIPT: ("type", "function", "property"), OPENAPI: ("operation",)}

#: Names of the tags that acknowledge a unit: as done, and as left out on purpose.
TAGS = ("cite", "citeExclude")

FILES = "path string, content binary"
UNIT = "id string, parent_id string, target string, identity array<string>, aliases array<string>, artifact string, symbol string, path string, line int, readable string"
DECLARATION = "id string, artifact string, tag string, target string, is_link boolean, reason string, hosts array<string>, path string, line int, seq int"
PROBLEM = "code string, symbol string, message string"
IMPORT = "local string, specifier string, imported string, is_namespace boolean"
EXPORT = "public string, local string, specifier string, imported string, is_namespace boolean, ord int"
IDENTITY = "local string, addresses array<string>, line int, ord int"
HOST = "symbol string, targets array<string>, pos int, line int, has_content boolean, has_empty boolean"


def _fields(ddl: str) -> str:
    """A column list as the fields of a struct."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


def rows(ddl: str) -> str:
    return f"array<struct<{_fields(ddl)}>>"


SCAN = ", ".join(
    [
        "path string, artifact string",
        f"units {rows(UNIT)}",
        f"declarations {rows(DECLARATION)}",
        f"problems {rows(PROBLEM)}",
        f"imports {rows(IMPORT)}",
        f"exports {rows(EXPORT)}",
        f"identities {rows(IDENTITY)}",
        "anonymous_line int",
        f"doc_hosts {rows(HOST)}",
    ]
)
DIAGNOSTICS = "code string, claim_idx int, ref_idx int, path string, line int, message string"
CLAIMS = "claim_idx int, artifact string, name string, host_symbols array<string>, label string"
REFERENCES = "claim_idx int, ref_idx int, artifact string, source string, entry string, package string, by_entry boolean, symbols array<string>, label string"
