"""Readers and writers of the artifacts of patch studies. Every read has an explicit schema."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.functions.batches import batch_lines, latest, listed, next_marked

# Extensions of files that are analysed.
EXTENSIONS = ("c", "cpp", "c++", "cc", "C", "h", "hpp", "hxx")

WORK = "CVE_ID string, patch string, TOOL_R2 string"
GRAPH = "struct<points: array<string>, edges: array<array<string>>>"
CALL_GRAPH = f"pre {GRAPH}, post {GRAPH}"
NODE = "struct<file: string, method: string, lineNumber: int>"
TAINT = f"pre array<array<{NODE}>>, post array<array<{NODE}>>"
DIAG = "Level string, DiagnosticName string, DiagnosticMessage struct<Message: string, FileOffset: int>"


def read_texts(spark: SparkSession, path: str, charset: str = "ISO-8859-1", glob: str | None = None) -> DataFrame:
    """(path, text): whole files in a given character set."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select("path", F.decode("content", charset).alias("text"))


def read_work(spark: SparkSession, path: str) -> DataFrame:
    """(CVE_ID, repo_name, pre_commit, post_commit, repohost, tool_results) of a work table in CSV or Parquet.

    A cell holds one commit address a line: the first is where a fix starts, the last where it ends.
    """
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.schema(WORK).option("header", True).option("multiLine", True).csv(path)
    return work_items(raw)


def work_items(raw: DataFrame) -> DataFrame:
    urls = F.filter(F.transform(F.split("patch", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    raw = raw.withColumns({"_first": F.get(urls, F.lit(0)), "_last": F.get(urls, F.size(urls) - 1)})
    post = F.when(T.repo_host(F.col("_first")) == "ghostscript", T.commit_id(F.col("_first"))).otherwise(T.commit_id(F.col("_last")))
    return raw.select("CVE_ID", T.repo_name(F.col("_first")).alias("repo_name"), T.commit_id(F.col("_first")).alias("pre_commit"), post.alias("post_commit"), T.repo_host(F.col("_first")).alias("repohost"), F.col("TOOL_R2").alias("tool_results"))


def scrub_commit(commit: Column) -> Column:
    """A commit id without white space and what follows a #, ? or /."""
    return F.regexp_replace(F.trim(commit), r"[\s#?/].*$", "")


def file_header(section: Column) -> tuple[Column, Column]:
    """(old, new) names in a section's first line, without a/ and b/."""
    head = F.element_at(F.split(section, "\n"), 1)
    return F.regexp_extract(head, r"^diff --git (?:a/)?(\S+) ", 1), F.regexp_extract(head, r"^diff --git \S+ (?:b/)?(\S+)", 1)


def allowed(name: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a file's extension, after its last dot, is among those analysed."""
    return F.coalesce(F.regexp_extract(name, r"\.([^./]*)$", 1).isin(*extensions), F.lit(False))


def with_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """files (repo, pre_commit, post_commit, old_file, new_file) with old_text and new_text from blobs (repo, commit, path,
    text); null where a path is not there."""
    old = blobs.select("repo", F.col("commit").alias("pre_commit"), F.col("path").alias("old_file"), F.col("text").alias("old_text"))
    new = blobs.select("repo", F.col("commit").alias("post_commit"), F.col("path").alias("new_file"), F.col("text").alias("new_text"))
    return files.join(old, ["repo", "pre_commit", "old_file"], "left").join(new, ["repo", "post_commit", "new_file"], "left")


def answer_diffs(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, diff, status): diffs in answers written as markdown: lines inside ```diff fences, and bare ones from a
    `diff --git` line on to the next fence or the end.

    status is found, wrong_answer (a fence that closes nothing, or no diff at all) or not_found (null text). An opening
    fence inside an open diff starts it anew, leaving what was open out. An answer is read whole within its task, so no
    line is shuffled or sorted.
    """
    schema = f"`{key}` {answers.schema[key].dataType.simpleString()}, diff string, status string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *fenced(batch.column(1))], [key, "diff", "status"])

    return answers.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def fenced(texts: pa.Array) -> list[pa.Array]:
    """[diff, status] of answer_diffs() for an array of answers, over the lines of all at once."""
    l = batch_lines(texts)
    begins = lambda x: pc.starts_with(l.text, x).to_numpy(zero_copy_only=False)
    starts = begins("```diff")
    close = begins("```") & ~starts
    git = begins("diff --git ")
    event = starts | close | git
    n = len(event)
    last, then = latest(event), next_marked(event)
    before = np.append(-1, last)[:n]
    bad = close & ((before < l.first) | close[before])
    # an open segment without an end mark is dropped when another fence opens right after it
    again = (then < n) & (l.row[np.minimum(then, n - 1)] == l.row) & starts[np.minimum(then, n - 1)]
    inside = (last >= l.first) & ~close[last] & ~starts & ~again
    diff = pc.binary_join(listed(l.text.filter(pa.array(inside)), l.row[inside], len(texts)), "\n")
    wrong = pc.or_(pa.array(np.bincount(l.row[bad], minlength=len(texts)) > 0), pc.equal(diff, ""))
    status = pc.if_else(pc.is_null(texts), "not_found", pc.if_else(wrong, "wrong_answer", "found"))
    return [pc.if_else(pc.equal(status, "found"), diff, pa.scalar(None, pa.string())), status]


def call_graph(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(points (keys, version, node), edges (keys, version, src, dst, src_line, tgt_line)) of call graphs read with CALL_GRAPH."""
    v = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("version"), F.col(x).alias("g")) for x in ("pre", "post")])).alias("x")).select(*keys, "x.version", "x.g")
    points = v.select(*keys, "version", F.explode("g.points").alias("node"))
    e = v.select(*keys, "version", F.explode("g.edges").alias("e"))
    return points, e.select(*keys, "version", F.get("e", F.lit(0)).alias("src"), F.get("e", F.lit(1)).alias("dst"), F.get("e", F.lit(2)).cast("int").alias("src_line"), F.get("e", F.lit(3)).cast("int").alias("tgt_line"))


def taint_nodes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, version, path_id, pos, file, method, line) of traces read with TAINT."""
    v = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("version"), F.col(x).alias("g")) for x in ("pre", "post")])).alias("x"))
    p = v.select(*keys, "x.version", F.posexplode("x.g").alias("path_id", "path"))
    n = p.select(*keys, "version", "path_id", F.posexplode("path").alias("pos", "n"))
    return n.select(*keys, "version", "path_id", "pos", "n.file", "n.method", F.col("n.lineNumber").alias("line"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def fuzz_events(logs: DataFrame, *keys: str, text: str = "text", file: str = "file") -> DataFrame:
    """(keys, tool, found_sec, pos): "found at N sec." events of fuzz logs; the tool is in the file's name, else in the
    heading above the event, else null."""
    l = logs.select(*keys, file, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    head = F.nullif(F.lower(F.regexp_extract("line", r"(?i)^#+\s*(aflgo|beacon)\b", 1)), F.lit(""))
    named = F.when(F.lower(file).rlike("aflgo"), "aflgo").when(F.lower(file).rlike("bea?con"), "beacon")
    l = l.withColumn("tool", F.coalesce(named, F.last(head, ignorenulls=True).over(Window.partitionBy(*keys, file).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))))
    sec = F.nullif(F.regexp_extract("line", r"found at (\d+) sec", 1), F.lit(""))
    return l.withColumn("found_sec", sec.cast("int")).where("found_sec is not null").select(*keys, "tool", "found_sec", "pos")


def crash_name(name: Column) -> list[Column]:
    """Parts of a crash file's name: id, number, signal, source, operation, repetitions; null where missing."""
    part = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return [part(r"id:(\d+)").alias("crash_id"), part(r"id:\d+,(\d+)").cast("long").alias("n"), part(r"sig:(\d+)").cast("int").alias("sig"), part(r"src:([\d+]+)").alias("src"), part(r"op:(\w+)").alias("op"), part(r"rep:(\d+)").cast("int").alias("rep")]


def normal_diff(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, op, old_start, old_end, new_start, new_end, side, text): lines of diffs in normal format."""
    cmd = r"^(\d+)(?:,(\d+))?([acd])(\d+)(?:,(\d+))?$"
    l = rows.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    is_ = F.col("line").rlike(cmd)
    num = lambda i: F.nullif(F.regexp_extract("line", cmd, i), F.lit("")).cast("int")
    s = F.struct(F.regexp_extract("line", cmd, 3).alias("op"), num(1).alias("old_start"), F.coalesce(num(2), num(1)).alias("old_end"), num(4).alias("new_start"), F.coalesce(num(5), num(4)).alias("new_end"))
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("c", F.last(F.when(is_, s), ignorenulls=True).over(run))
    side = F.substring("line", 1, 1)
    return l.where(~is_ & side.isin("<", ">") & F.col("c").isNotNull()).select(*keys, "pos", "c.*", side.alias("side"), F.substring("line", 3, 1 << 30).alias("text"))


def node_mapping(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, src_kind, src_line, dst_kind, dst_line) of lines `kind @ n @ kind @ n @`."""
    p = r"^(.*?)\s+@ (\d+) @ (.*?)\s+@ (\d+) @\s*$"
    l = rows.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(p))
    e = lambda i: F.regexp_extract("line", p, i)
    return l.select(*keys, "pos", e(1).alias("src_kind"), e(2).cast("int").alias("src_line"), e(3).alias("dst_kind"), e(4).cast("int").alias("dst_line"))


def errors_of(diags: DataFrame, *keys: str) -> DataFrame:
    """(keys, level, name, message, offset) of diagnostics read with DIAG that are errors."""
    return diags.where(F.col("Level") == "Error").select(*keys, F.col("Level").alias("level"), F.col("DiagnosticName").alias("name"), F.col("DiagnosticMessage.Message").alias("message"), F.col("DiagnosticMessage.FileOffset").alias("offset"))


def escape_dot(text: Column) -> Column:
    """DOT text in which quotes inside quoted names are escaped: those that neither begin nor end a name.

    A quote begins a name after a line's start, blank, =, [, comma, ; or {, and ends one before a line's end, blank, comma,
    ], ; or }. Escaped ones stay as they are.
    """
    return F.regexp_replace(text, r'(?m)(?<![\\\s=\[,;{])(?<!^)"(?![\s,\];}]|$)', r'\\"')


def dot_edges(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, src, dst) of edges `a -> b` in DOT graphs, quoted or plain names; other statements are left out.

    Names with quotes that nobody escaped need escape_dot() first.
    """
    p = r"""^\s*("(?:\\.|[^"\\])*"|[\w.#:/]+)\s*->\s*("(?:\\.|[^"\\])*"|[\w.#:/]+)"""
    l = rows.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(p))
    plain = lambda i: F.regexp_replace(F.regexp_extract("line", p, i), r'^"|"$', "")
    bare = lambda i: F.replace(F.replace(F.replace(F.replace(plain(i), F.lit("\\\\"), F.lit("\x01")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\x01"), F.lit("\\"))
    return l.select(*keys, "pos", bare(1).alias("src"), bare(2).alias("dst"))


def to_dot(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, dot): graphs as DOT text, edges in order of their ends; backslashes, quotes and line feeds in names are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    line = F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";"))
    g = edges.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return g.select(*keys, F.concat(F.lit("digraph {\n"), F.col("body"), F.lit("\n}\n")).alias("dot"))


def write_code_tree(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """files (path, text) as a table partitioned by path; an existing tree stays unless told otherwise."""
    files.write.mode("overwrite" if overwrite else "ignore").partitionBy("path").parquet(path)


def write_json(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def nearest_parent(paths: DataFrame, files: DataFrame, filename: str) -> DataFrame:
    """(path, parent): the nearest folder at or above each path that holds a file of this name; null if none does.

    files has a column path. The empty folder is the top.
    """
    parts = F.split("path", "/")
    up = paths.select("path").distinct().select("path", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up", "dir"))
    has = files.select(F.col("path").alias("_f")).distinct()
    at = F.when(F.col("dir") == "", F.lit(filename)).otherwise(F.concat(F.col("dir"), F.lit(f"/{filename}")))
    hit = up.withColumn("_f", at).join(has, "_f", "left_semi").groupBy("path").agg(F.min_by("dir", "up").alias("parent"))
    return paths.select("path").distinct().join(hit, "path", "left")


def with_description(items: DataFrame, descriptions: DataFrame, key: str, text: str = "description") -> DataFrame:
    """items with the text of their description; null where there is none. Of several, the least counts."""
    one = descriptions.groupBy(key).agg(F.min(text).alias(text))
    return items.join(one, key, "left")


def compare_artifacts(artifacts: DataFrame, pairs: list[tuple[str, str]], *keys: str) -> DataFrame:
    """(keys, left, right, is_same) for named pairs of artifacts (keys, name, text); pairs with a missing side are left out."""
    table = F.broadcast(artifacts.sparkSession.createDataFrame(pairs, "left string, right string"))
    l = artifacts.select(*keys, F.col("name").alias("left"), F.col("text").alias("_l")).join(table, "left")
    r = artifacts.select(*keys, F.col("name").alias("right"), F.col("text").alias("_r"))
    return l.join(r, [*keys, "right"]).select(*keys, "left", "right", (F.col("_l") == F.col("_r")).alias("is_same"))
