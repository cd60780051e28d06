"""Project files to scan rows, and scan rows to flat relations.

Each file is read and scanned once, by the task that holds it. What the
configuration doesn't ask for is neither listed nor read.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline import model
from plumbline.config import GraphConfig
from plumbline.functions.globs import GlobSet, selected
from plumbline.functions.lineage import stored
from plumbline.functions.text import is_module, package_name
from plumbline.sources import markdown, openapi, typescript


def read_tree(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """(path relative to root, content) of the files below folders, all of root by default."""
    base = root.rstrip("/")
    wanted = [f"{base}/{x}".rstrip("/") for x in (folders if folders is not None else [""])]
    found = [p for p in wanted if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], model.FILES)
    raw = _packed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(found))
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    stem = "/" + base.split("://", 1)[-1].lstrip("/") + "/"
    return raw.select(F.substring(plain, len(stem) + 1, 1 << 30).alias("path"), "content")


def _packed(raw: DataFrame) -> DataFrame:
    """raw in fewer and longer tasks: Spark counts 4 MB for opening a file, so it reads 32 small ones a task, and each task is a file of what is stored of it."""
    splits = raw.rdd.getNumPartitions()
    return raw.coalesce(max(4 * raw.sparkSession.sparkContext.defaultParallelism, splits // 64))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in partitions for all cores: a table of narrow rows is a split or two, however many files its rows are made into."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def _place(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    files, p = _place(spark, path)
    return files.exists(p)


def root_problem(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """(code, message) if the folder isn't there or can't be listed."""
    try:
        files, p = _place(spark, root)
        if not files.exists(p):
            return "root_unresolved", f"there is no folder '{root}'"
        if not files.getFileStatus(p).isDirectory():
            return "root_unreadable", f"'{root}' is no folder"
        files.listStatusIterator(p).hasNext()
    except Py4JJavaError as e:
        return "root_unreadable", f"'{root}' can't be read: {str(e.java_exception.getMessage() or e.java_exception).splitlines()[0]}"
    return None


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, content) as files below a folder, on any file system that pyarrow knows; a file is there whole or not at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root)) if ":" in root.split("/")[0] else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = posixpath.join(base, path)
                if (folder := posixpath.dirname(name)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(content if content is not None else b""))
                system.move(part, name)
            yield pd.DataFrame({"n": [len(b)]})

    files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def folders_of(config: GraphConfig, program: GlobSet | None) -> list[str] | None:
    """Folders that hold all that the configuration may ask for; None: the whole tree."""
    roots: set[str] = set()
    typescript_asked = any(c.artifact == model.TYPESCRIPT for c in config.claims) or config.references(model.TYPESCRIPT)
    if typescript_asked:
        roots |= set(program.roots()) if program else {""}
        roots.add("node_modules/")
    for c in config.claims:
        if c.artifact == model.MARKDOWN:
            roots |= set(c.globs.roots())
    for _, r in config.references(model.MARKDOWN):
        roots |= set(r.globs.roots())
    for _, r in config.references(model.OPENAPI):
        if "://" not in r.source:
            roots.add(posixpath.dirname(r.source) + "/" if "/" in r.source else "")
    if "" in roots:
        return None
    kept = sorted(roots)
    return [p.rstrip("/") for p in kept if not any(p != q and p.startswith(q) for q in kept)]


class Unreadable(ValueError):
    """Why a file can't be scanned."""


#: The arrays of a scan row.
PARTS = ("units", "declarations", "problems", "imports", "exports", "identities", "doc_hosts")
#: Bytes that a row or an item of its arrays counts as, and of scan rows that are sent on together.
ITEM, SLICE = 512, 4 << 20


def _cost(row: dict, content: bytes | None) -> int:
    """About how many bytes a file and its scan row take."""
    return ITEM * (1 + sum(len(x) for x in row.values() if isinstance(x, list))) + (len(content) if content is not None else 0)


def _slices(batches: Iterable[pa.RecordBatch], one: Callable[[str, bytes | None], dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The scan rows of batches of (path, content), sent on whenever those held take about SLICE bytes, however many files come at once."""
    held, size = [], 0
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content")):
            path, content = path.as_py(), content.as_py()
            held.append(one(path, content))
            size += _cost(held[-1], content)
            if size >= SLICE:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _scanned(rows: DataFrame, artifact: str, code: str, one: Callable[[str, bytes | None], dict], parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Scan rows of (path, content), of their arrays those in parts; whatever a scanner raises is that file's problem, of that code."""
    kept = {"path", "artifact", "problems", *parts} | ({"anonymous_line"} if "identities" in parts else set())
    fields = StructType([f for f in StructType.fromDDL(model.SCAN).fields if f.name in kept])
    schema = to_arrow_schema(fields)
    empty = {name: [] for name in PARTS} | {"anonymous_line": None}

    def guarded(path: str, content: bytes | None) -> dict:
        try:
            return one(path, content)
        except Unreadable as e:
            why = str(e)
        except Exception as e:  # noqa: BLE001 - one file mustn't end the job of all
            why = f"{type(e).__name__}: {e}"
        shown = openapi.shown(path) if artifact == model.OPENAPI else path
        return {"path": path, "artifact": artifact, "problems": [{"code": code, "symbol": "*", "message": f"'{shown}' can't be scanned: {why}"}]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _slices(batches, lambda path, content: empty | guarded(path, content), schema)

    return rows.select("path", "content").mapInArrow(run, fields)


def _text(content: bytes | None) -> str:
    if content is None:
        raise Unreadable("it has no content")
    try:
        return bytes(content).decode("utf-8")
    except UnicodeDecodeError as e:
        raise Unreadable(f"it isn't UTF-8 at byte {e.start}") from e


def scan_markdown(files: DataFrame, words: tuple[str, str] = model.TAGS) -> DataFrame:
    return _scanned(files, model.MARKDOWN, "md_unreadable", lambda p, c: markdown.scan(p, _text(c), words))


def scan_typescript(files: DataFrame, words: tuple[str, str] = model.TAGS, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """parts: the arrays that are wanted; the others are neither made nor moved."""
    return _scanned(files, model.TYPESCRIPT, "ts_unreadable", lambda p, c: typescript.scan(p, _text(c), words, parts), parts)


def scan_openapi(sources: DataFrame, fetch: Callable[[str], bytes] = openapi.fetch) -> DataFrame:
    """sources has path and, for local ones that exist, content."""

    def one(source: str, content: bytes | None) -> dict:
        def read() -> bytes:
            if "://" in source:
                return fetch(source)
            if content is None:
                raise openapi.SourceError("there is no such file")
            return bytes(content)

        return openapi.scan(source, read)

    return _scanned(sources, model.OPENAPI, "swagger_bridge", one)


def in_program(path: F.Column) -> F.Column:
    return is_module(path) & ~path.rlike("(^|/)node_modules/")


def project_scan(spark: SparkSession, files: DataFrame, config: GraphConfig, program: GlobSet | None = None, fetch: Callable[[str], bytes] = openapi.fetch, words: tuple[str, str] = model.TAGS) -> DataFrame:
    """Scan rows of all that the configuration asks for, computed once."""
    parts = []
    wanted = {f"c{c.index}": c.globs for c in config.claims if c.artifact == model.MARKDOWN}
    wanted |= {f"c{c.index}r{r.index}": r.globs for c, r in config.references(model.MARKDOWN)}
    if wanted:
        # a filter on paths, so that the contents of other files are never read or moved
        parts.append(scan_markdown(files.filter(selected(F.col("path"), list(wanted.values()))), words))
    sources = sorted({r.source for _, r in config.references(model.OPENAPI)})
    if sources:
        asked = spark.createDataFrame([(s,) for s in sources], "path string")
        parts.append(scan_openapi(asked.join(files, "path", "left").select("path", "content"), fetch))
    if any(c.artifact == model.TYPESCRIPT for c in config.claims) or config.references(model.TYPESCRIPT):
        own = files.filter(in_program(F.col("path")))
        done: set[str] = set()
        todo = {r.package for _, r in config.references(model.TYPESCRIPT) if r.package}
        scans = [stored(scan_typescript(own, words)) if todo else scan_typescript(own, words)]
        while todo:
            done |= todo
            package = package_name(F.regexp_replace("path", "^node_modules/", ""))
            inner = files.filter(F.col("path").startswith("node_modules/") & is_module(F.col("path")) & package.isin(sorted(todo)) & ~F.substring("path", 14, 1 << 30).contains("/node_modules/"))
            scans.append(stored(scan_typescript(inner, words)))
            bare = scans[-1].select(F.explode("exports.specifier").alias("s")).filter("s is not null and not s like './%' and not s like '../%' and not s like '/%'")
            todo = {r[0] for r in bare.select(package_name(F.col("s"))).distinct().collect()} - done
        parts += scans
    if not parts:
        return spark.createDataFrame([], model.SCAN)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out)


def flat(scan: DataFrame, column: str, *keep: str) -> DataFrame:
    """The rows of one of the scan's arrays, file naming the file they are from."""
    return scan.select(F.col("path").alias("file"), *keep, F.explode(column).alias("_x")).select("file", *keep, "_x.*")
