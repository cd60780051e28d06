"""How scans are spread over tasks and how much of them is held at once."""

import json
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import __spark_entry__
from plumbline import model
from plumbline.plans import projects
from plumbline.sources import inventory, markdown, openapi, tags

SF = __spark_entry__.SMOKE_DIR


def sliced(scan, contents):
    """(files scanned, rows) at each batch that leaves a task which is given all files at once."""
    done = []

    def one(path, content):
        done.append(path)
        return scan(path, content)

    batch = pa.RecordBatch.from_pydict({"path": [f"f{k}" for k in range(len(contents))], "content": contents}, pa.schema([("path", pa.string()), ("content", pa.binary())]))
    out = [(len(done), b) for b in inventory._slices([batch], one, to_arrow_schema(StructType.fromDDL(model.SCAN)))]
    assert [p for _, b in out for p in b.column("path").to_pylist()] == done
    return out


def test_descriptions_leave_in_slices(spark):
    text = json.dumps({"openapi": "3.2.0", "paths": {f"/events/{k}": {"get": {}, "put": {}} for k in range(200)}}).encode()
    out = sliced(lambda p, c: openapi.scan(p, lambda: c), [text] * 100)
    assert len(out) > 3 and out[0][0] < 30
    assert sum(len(u) for _, b in out for u in b.column("units").to_pylist()) == 100 * 400


def test_long_texts_leave_in_slices(spark):
    out = sliced(lambda p, c: markdown.scan(p, c.decode()), [b"# A\n" + b"word " * 100_000] * 30)
    assert len(out) > 2 and out[0][0] < 15
    assert [len(u) for _, b in out for u in b.column("units").to_pylist()] == [2] * 30


def peak_of(run):
    """(what run gives, most bytes that it held)"""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_markdown_file_of_many_lines_takes_little_besides_its_text():
    text = "# A\n" + "abcde\n" * 300_000 + "<!-- @cite a.md why -->\n"
    row, peak = peak_of(lambda: markdown.scan("f.md", text))
    assert [u["line"] for u in row["units"]] == [1, 1] and [(d["line"], d["hosts"]) for d in row["declarations"]] == [(300_002, ["h1"])]
    assert peak < 2 * len(text)


def test_a_comment_of_many_lines_takes_little_besides_its_text():
    text = "/**\n" + "abcde\n" * 300_000 + "@cite a.md why\n*/"
    found, peak = peak_of(lambda: tags.tags(text))
    assert [(t.target, t.reason, t.offset) for t in found] == [("a.md", "why", 300_001)]
    assert peak < 4 * len(text)


@pytest.mark.parametrize("block", [0, 1, 5, 17])
def test_lines_are_the_same_in_any_blocks(monkeypatch, block):
    text = "# A\r\n\n\n```\n<!-- @cite b.md no -->\n# B\n```\r\n<!--\n# C\n@cite a.md one\n--><!-- @cite a.md two -->\n## D\r\nx <!-- @cite a.md three -->\n"
    whole = markdown.scan("f.md", text)
    monkeypatch.setattr(tags, "BLOCK", block)
    assert list(tags.lines(text)) == text.split("\n")
    assert markdown.scan("f.md", text) == whole
    assert [(u["symbol"], u["line"]) for u in whole["units"]] == [("file", 1), ("h1", 1), ("h2", 12)]
    assert [(d["line"], d["hosts"]) for d in whole["declarations"]] == [(10, ["h1"]), (11, ["h1"]), (13, ["h2"])]


@pytest.mark.parametrize("name", ["typescript_scan", "typescript_forms", "singular_rule", "documented_rule"])
def test_rows_of_one_split_are_scanned_by_several_tasks(spark, name):
    found = __spark_entry__.queries()[name](spark, SF)
    assert found.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize(("name", "root"), [("import_scope_rule", "api/"), ("graph_rule", "spec/"), ("citation_problems", "spec/")])
def test_files_of_one_split_are_scanned_by_several_tasks(spark, monkeypatch, name, root):
    class Enough(Exception):
        pass

    def keep(spark, files, *_, **__):
        raise Enough(files)

    monkeypatch.setattr(projects, "check_files", keep)
    with pytest.raises(Enough) as e:
        __spark_entry__.queries()[name](spark, SF)
    files = e.value.args[0].filter(F.col("path").startswith(root))
    assert files.select(F.spark_partition_id()).distinct().count() > 1


def test_only_wanted_parts_are_scanned(spark):
    files = spark.createDataFrame([("a.ts", bytearray(b"/** A. */\nexport interface A { b: 1 }\n")), ("b.ts", bytearray(b"\xff"))], model.FILES)
    for part, more in (("units", []), ("doc_hosts", []), ("declarations", []), ("identities", ["anonymous_line"])):
        whole, own = inventory.scan_typescript(files), inventory.scan_typescript(files, parts=(part,))
        assert set(own.columns) == {"path", "artifact", "problems", part, *more}
        assert sorted(own.collect()) == sorted(whole.select(own.columns).collect())


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    want = {f"a/f{k}.md": f"# {k}\n".encode() for k in range(400)}
    (tmp_path / "a").mkdir()
    for name, content in want.items():
        (tmp_path / name).write_bytes(content)
    files = inventory.read_tree(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {r.path: bytes(r.content) for r in files.collect()} == want
