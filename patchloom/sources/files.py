"""Files that Spark has no reader or writer for: spreadsheets, Git repositories, and trees of source files."""

from __future__ import annotations

import mmap
import os
import re
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from patchloom.session import checkpointed, prepare

# --- Spreadsheets ---

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    parts = [t.text or "" for t in node.findall("m:t", _NS)] + [t.text or "" for r in node.findall("m:r", _NS) for t in r.findall("m:t", _NS)]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts)).replace("\r\n", "\n")


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (by default the first) of an .xlsx file, cells as text: shared and own strings as they are, line
    breaks included, numbers as written, truth values as 1 and 0, cells that are missing or hold an error as null."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        chosen = next((s for s in sheets if sheet in (None, s.get("name"))), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r}")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[chosen.get(f"{{{_NS['r']}}}id")]
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with z.open(name) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    v, kind = c.find("m:v", _NS), c.get("t", "n")
                    if kind == "inlineStr":
                        out[at] = _text(c.find("m:is", _NS))
                    elif v is not None and v.text is not None and kind != "e":
                        out[at] = shared[int(v.text)] if kind == "s" else v.text
                yield out
                row.clear()


def read_sheets(spark: SparkSession, path: str, schema: str | T.StructType, sheet: str | None = None) -> DataFrame:
    """Rows of .xlsx files by an explicit schema: columns are found by the names in the first row that holds any.

    Cells are cast to the schema's types as Spark casts text. Columns that a file lacks are null; rows without any cell
    are left out. One file is one task's work; files are read by Spark, from any store.
    """
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    names = wanted.fieldNames()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                head, rows = None, []
                for row in sheet_rows(content.as_py(), sheet):
                    if all(x is None for x in row):
                        continue
                    if head is None:
                        head = {x.strip(): i for i, x in reversed(list(enumerate(row))) if x is not None}
                        continue
                    rows.append([row[head[n]] if n in head and head[n] < len(row) else None for n in names])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    raw = prepare(spark).read.format("binaryFile").load(path).select("content").mapInArrow(parse, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])


# --- Git repositories ---

_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


class Pack:
    """A pack of objects with its index, both mapped into memory: objects by place or by name, delta chains resolved."""

    def __init__(self, path: str):
        self.data = self._mapped(path)
        self.index = self._mapped(path[: -len(".pack")] + ".idx")
        if self.index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: only packs with an index of version 2 are read")
        self.n = struct.unpack(">I", self.index[8 + 255 * 4 : 8 + 256 * 4])[0]

    @staticmethod
    def _mapped(path: str) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def name(self, i: int) -> bytes:
        return self.index[1032 + 20 * i : 1052 + 20 * i]

    def offset(self, i: int) -> int:
        at = 1032 + 24 * self.n + 4 * i
        x = struct.unpack(">I", self.index[at : at + 4])[0]
        if x & 0x80000000:
            at = 1032 + 28 * self.n + 8 * (x & 0x7FFFFFFF)
            return struct.unpack(">Q", self.index[at : at + 8])[0]
        return x

    def find(self, name: bytes) -> int:
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.name(mid) < name else (lo, mid)
        if lo == self.n or self.name(lo) != name:
            raise KeyError(name.hex())
        return self.offset(lo)

    def get(self, at: int) -> tuple[str, bytes]:
        """(kind, body) of the object at a place: deltas are followed down to a whole object, then applied upwards."""
        deltas = []
        while True:
            start, byte = at, self.data[at]
            kind, at = byte >> 4 & 7, at + 1
            while byte & 0x80:
                byte, at = self.data[at], at + 1
            base = None
            if kind == 6:
                byte, at = self.data[at], at + 1
                back = byte & 0x7F
                while byte & 0x80:
                    byte, at = self.data[at], at + 1
                    back = (back + 1 << 7) | byte & 0x7F
                base = start - back
            elif kind == 7:
                base, at = self.find(self.data[at : at + 20]), at + 20
            body = inflated(self.data, at)
            if base is None:
                for d in reversed(deltas):
                    body = patched(body, d)
                return _KINDS[kind], body
            deltas.append(body)
            at = base


def inflated(data: mmap.mmap, at: int) -> bytes:
    z, out = zlib.decompressobj(), []
    while not z.eof and at < len(data):
        out.append(z.decompress(data[at : at + 65536]))
        at += 65536
    return b"".join(out)


def patched(base: bytes, delta: bytes) -> bytes:
    """An object from its base: a delta lists copies out of the base and bytes of its own."""
    at = 0
    for _ in range(2):  # the sizes of base and result
        while delta[at] & 0x80:
            at += 1
        at += 1
    out = []
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 0x80:
            x = [0] * 7
            for i in range(7):
                if op >> i & 1:
                    x[i], at = delta[at], at + 1
            start, size = int.from_bytes(bytes(x[:4]), "little"), int.from_bytes(bytes(x[4:]), "little") or 0x10000
            out.append(base[start : start + size])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


@dataclass
class _Objects(InputPartition):
    """Loose objects of some folders, or a range of a pack's objects."""

    repo: str
    pack: str | None
    start: int
    end: int


class GitObjects(DataSource):
    """Objects of repositories in a folder that all executors see: (repo, sha, kind, body).

    Options: path, a repository or its .git folder; several are separated by line feeds; objects, how many of a pack are
    one partition's. The 256 folders of loose objects are dealt to 16 partitions a repository. An object that is both loose
    and packed is there twice, with the same body.
    """

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return "repo string, sha string, kind string, body binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repos = [p for p in options["path"].split("\n") if p]
        self.objects = int(options.get("objects", 20_000))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for repo in self.repos:
            at = self.folder(repo)
            for pack in sorted(at.glob("pack/*.pack")):
                n = Pack(str(pack)).n
                out += [_Objects(repo, str(pack), i, min(n, i + self.objects)) for i in range(0, n, self.objects)]
            out += [_Objects(repo, None, i, i + 16) for i in range(0, 256, 16)]
        return out

    @staticmethod
    def folder(repo: str) -> Path:
        inner = Path(repo, ".git")
        at = Path(inner if inner.is_dir() else repo, "objects")
        if not at.is_dir():
            raise FileNotFoundError(f"{repo} holds no repository")
        return at

    def read(self, partition: _Objects) -> Iterator[tuple[str, str, str, bytes]]:
        if partition.pack:
            pack = Pack(partition.pack)
            for i in range(partition.start, partition.end):
                yield partition.repo, pack.name(i).hex(), *pack.get(pack.offset(i))
            return
        for i in range(partition.start, partition.end):
            for f in sorted(self.folder(partition.repo).glob(f"{i:02x}/" + "[0-9a-f]" * 38)):
                head, _, body = zlib.decompress(f.read_bytes()).partition(b"\0")
                yield partition.repo, f.parent.name + f.name, head.split(b" ")[0].decode(), body


def git_objects(spark: SparkSession, *repos: str, objects: int = 20_000) -> DataFrame:
    """(repo, sha, kind, body): see GitObjects."""
    prepare(spark).dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", "\n".join(repos)).option("objects", objects).load()


def _tree_entries(trees: DataFrame) -> DataFrame:
    """(repo, tree, name, sha, is_tree): the entries of tree objects."""
    kind = pa.list_(pa.struct([("name", pa.string()), ("sha", pa.string()), ("is_tree", pa.bool_())]))

    @F.arrow_udf("array<struct<name:string,sha:string,is_tree:boolean>>")
    def entries(bodies: pa.Array) -> pa.Array:
        out = []
        for body in bodies.to_pylist():
            at, rows = 0, []
            while at < len(body):
                blank, end = body.index(b" ", at), body.index(b"\0", at)
                rows.append({"name": body[blank + 1 : end].decode("utf-8", "replace"), "sha": body[end + 1 : end + 21].hex(), "is_tree": body[at:blank] == b"40000"})
                at = end + 21
            out.append(rows)
        return pa.array(out, kind)

    return trees.select("repo", F.col("sha").alias("tree"), F.explode(entries("body")).alias("e")).select("repo", "tree", "e.*")


def blobs_at(objects: DataFrame, wanted: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """wanted (repo, commit, path, ...) with text: the file at that path in that commit, null where there is none.

    Commits may be given by the first characters of their names, from seven on, if these name one; then trees are walked down
    the path, a join a level for all rows together. Bytes that are no text of the charset are replaced.
    """
    objects = checkpointed(objects.dropDuplicates(["repo", "sha"]))
    body = F.col("body").cast("string")
    commits = objects.where("kind = 'commit'").select("repo", F.col("sha").alias("_commit"), F.regexp_extract(body, "^tree ([0-9a-f]{40})", 1).alias("_at"), F.substring("sha", 1, 7).alias("_head"))
    trees = checkpointed(_tree_entries(objects.where("kind = 'tree'")))
    rows = checkpointed(wanted.withColumn("_row", F.monotonically_increasing_id()))
    asked = rows.select("_row", "repo", F.lower("commit").alias("_asked"), F.filter(F.split("path", "/"), lambda x: (x != "") & (x != ".")).alias("_parts"))
    asked = asked.where((F.length("_asked") >= 7) & (F.size("_parts") > 0)).withColumn("_head", F.substring("_asked", 1, 7))
    found = asked.join(commits, ["repo", "_head"]).where(F.col("_commit").startswith(F.col("_asked")))
    found = found.groupBy("_row", "repo", "_parts").agg(F.count(F.lit(1)).alias("n"), F.first("_at").alias("_at")).where("n = 1").drop("n")
    deepest = asked.agg(F.max(F.size("_parts"))).first()[0] or 0
    level, done = found, None
    for i in range(deepest):
        step = level.join(trees, (level["repo"] == trees["repo"]) & (level["_at"] == trees["tree"]) & (F.get(level["_parts"], F.lit(i)) == trees["name"])).select("_row", level["repo"], "_parts", "sha", "is_tree")
        step = checkpointed(step)
        ends = step.where(~F.col("is_tree") & (F.size("_parts") == i + 1)).select("_row", "repo", "sha")
        done = ends if done is None else done.unionByName(ends)
        level = step.where("is_tree").select("_row", "repo", "_parts", F.col("sha").alias("_at"))
    if done is None:
        return rows.withColumn("text", F.lit(None).cast("string")).drop("_row")
    blobs = objects.where("kind = 'blob'").select("repo", "sha", "body")

    @F.arrow_udf("string")
    def decoded(bodies: pa.Array) -> pa.Array:
        return pa.array([None if b is None else b.decode(charset, "replace") for b in bodies.to_pylist()], pa.string())

    texts = done.join(blobs, ["repo", "sha"]).select("_row", decoded("body").alias("text"))
    return rows.drop("text").join(texts, "_row", "left").drop("_row")


# --- Trees of files ---


class CodeTree(DataSource):
    """A folder that all executors see, written as files: rows (path, text), one file a row at its own path below it.

    Options: path, the folder; overwrite, "true" to replace files that exist (by default they stay); charset. A task writes
    into a folder of its own and moves the files to their places when it is done, so that a task that fails leaves none.
    Folders of unfinished tasks go when the job ends. Paths that lead out of the folder are an error, rows without a
    path are too; a null text is an empty file. Of rows with one path one is kept.
    """

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        names = schema.fieldNames()
        return _TreeWriter(self.options, names.index("path"), names.index("text"))


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], path: int, text: int):
        self.root, self.charset = os.path.abspath(options["path"]), options.get("charset", "UTF-8")
        self.replace = options.get("overwrite", "false").lower() == "true"
        self.at, self.fields = os.path.join(self.root, f"_unfinished-{uuid.uuid4().hex}"), (path, text)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        own = os.path.join(self.at, uuid.uuid4().hex)
        moves: dict[str, str] = {}
        try:
            for row in rows:
                path, text = (row[i] for i in self.fields)
                to = os.path.normpath(os.path.join(self.root, path)) if path else self.root
                if not to.startswith(self.root + os.sep) or os.path.isabs(path):
                    raise ValueError(f"{path!r} is no path below the folder")
                if self.replace or not os.path.exists(to):
                    os.makedirs(own, exist_ok=True)
                    part = os.path.join(own, str(len(moves)))
                    with open(part, "wb") as f:
                        f.write((text or "").encode(self.charset))
                    moves[to] = part
            for to, part in moves.items():
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(part, to)
        finally:
            shutil.rmtree(own, ignore_errors=True)
        return _Written(len(moves))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.at, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.at, ignore_errors=True)


def write_files(files: DataFrame, path: str, overwrite: bool = False, charset: str = "UTF-8") -> None:
    """files (path, text) as files below a shared folder: see CodeTree."""
    prepare(files.sparkSession).dataSource.register(CodeTree)
    files.select("path", "text").write.format("code_tree").option("path", path).option("overwrite", str(overwrite).lower()).option("charset", charset).mode("append").save()
