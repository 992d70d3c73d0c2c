"""Gap-keyed merging of marked snippets, rendering of traces, fault selection and recovery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.batches import batch_lines, listed
from patchloom.session import checkpointed


def split_gaps(snippets: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, line, marked, gap): lines of snippets; a marked line starts with + or -; gap counts the unmarked
    (base) lines before it. White space around the whole text is taken off first. Null texts give no rows."""
    trimmed = F.regexp_replace(F.regexp_replace(F.col(text), r"^[ \t\n\r\f\x0b]+", ""), r"[ \t\n\r\f\x0b]+$", "")
    l = snippets.select(*keys, F.posexplode(F.split(trimmed, "\n", -1)).alias("pos", "line"))
    l = l.withColumn("marked", F.col("line").startswith("+") | F.col("line").startswith("-"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return l.withColumn("gap", F.coalesce(F.sum((~F.col("marked")).cast("int")).over(before), F.lit(0)).cast("int"))


def merge_snippets(snippets: DataFrame, key: str, snippet: str, text: str = "text", keep_unmarked: bool = False) -> DataFrame:
    """(key, first_snippet, n_snippets, merged): snippets of a key with equal base lines as one text.

    In each gap stand the marked lines of all snippets, in order of snippet and place; within one snippet and gap a
    repeated line counts once, across snippets it stays. Snippets without a marked line are left out unless kept.
    """
    g = split_gaps(snippets, key, snippet, text=text)
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "line")))), lambda x: x["line"])
    base = g.groupBy(key, snippet).agg(ordered(~F.col("marked")).alias("base"), F.max(F.col("marked").cast("int")).alias("any"))
    if not keep_unmarked:
        base = base.where("any = 1")
    marked = g.where("marked").groupBy(key, snippet, "gap", "line").agg(F.min("pos").alias("pos"))
    lists = marked.groupBy(key, snippet).agg(F.collect_list(F.struct("gap", "pos", "line")).alias("marks"))
    both = base.join(lists, [key, snippet], "left")
    item = F.struct(F.col("m.gap").alias("gap"), F.lit(0).alias("kind"), F.col(snippet).cast("long").alias("s"), F.col("m.pos").alias("pos"), F.col("m.line").alias("line"))
    marks = both.select(key, "base", snippet, F.explode_outer("marks").alias("m")).select(key, "base", F.col(snippet), F.when(F.col("m").isNotNull(), item).alias("x"))
    groups = marks.groupBy(key, "base").agg(F.min(snippet).alias("first_snippet"), F.countDistinct(snippet).alias("n_snippets"), F.collect_list("x").alias("xs"))
    bases = F.transform("base", lambda x, i: F.struct(i.cast("int").alias("gap"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("s"), i.cast("int").alias("pos"), x.alias("line")))
    text_ = F.array_join(F.transform(F.array_sort(F.concat("xs", bases)), lambda x: x["line"]), "\n")
    return groups.select(key, "first_snippet", "n_snippets", text_.alias("merged"))


def merged_lines(snippets: DataFrame, key: str, snippet: str, text: str = "text", keep_unmarked: bool = False) -> DataFrame:
    """(key, first_snippet, gap, marked, snippet, pos, line): what merge_snippets() puts into one text, as rows.

    The rows of a (key, first_snippet) in order of gap, marked ones first, then snippet and pos are the merged text; base
    lines have no snippet. No group is put together, so many snippets with equal base lines stay spread over the tasks:
    a snippet is read whole in its task, and they meet once, by the hash of their base lines, whose least snippet is an aggregate.
    """
    trimmed = F.regexp_replace(F.regexp_replace(F.col(text), r"^[ \t\n\r\f\x0b]+", ""), r"[ \t\n\r\f\x0b]+$", "")
    rows = snippets.select(key, snippet, trimmed.alias("_text")).where("_text is not null")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *gathered(batch.column(2))], [key, snippet, "base", "marks"])

    base = rows.mapInArrow(run, f"{own}, base array<string>, marks array<struct<gap:int,pos:int,line:string>>")
    if not keep_unmarked:
        base = base.where(F.size("marks") > 0)
    # lengths before lines, so that different lists never read as one text
    name = F.sha2(F.array_join(F.transform("base", lambda x: F.concat(F.length(x), F.lit(":"), x)), ""), 256)
    # read for the least snippet of a name and for the lines
    base = checkpointed(base.select(key, snippet, "base", "marks", name.alias("_name")))
    first = base.groupBy(key, "_name").agg(F.min(snippet).alias("first_snippet"))
    base = base.join(first, [key, "_name"])
    marked = base.select(key, "first_snippet", F.col(snippet), F.inline("marks"))
    marked = marked.select(key, "first_snippet", "gap", F.lit(True).alias("marked"), F.col(snippet), "pos", "line")
    lines = base.where(F.col(snippet) == F.col("first_snippet")).select(key, "first_snippet", F.posexplode("base").alias("gap", "line"))
    none = F.lit(None).cast(dict(base.dtypes)[snippet])
    return marked.unionByName(lines.select(key, "first_snippet", "gap", F.lit(False).alias("marked"), none.alias(snippet), F.col("gap").alias("pos"), "line"))


def gathered(texts: pa.Array) -> list[pa.Array]:
    """[base, marks] of an array of snippets: unmarked lines, and the marked ones as (gap, pos, line), a repeated line of a gap
    at its first place only; over the lines of all snippets at once."""
    l = batch_lines(texts)
    marked = (l.lead == ord("+")) | (l.lead == ord("-"))
    before = np.cumsum(~marked) - ~marked  # of all snippets
    gap = before - before[l.first] if len(before) else before
    at = np.flatnonzero(marked)
    code = l.text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, once = np.unique(np.stack([l.row[at], gap[at], code[at]]), axis=1, return_index=True)
    at = at[np.sort(once)]
    marks = pa.StructArray.from_arrays([pa.array(gap[at].astype(np.int32)), pa.array((at - l.first[at]).astype(np.int32)), l.text.take(pa.array(at))], ["gap", "pos", "line"])
    return [listed(l.text.filter(pa.array(~marked)), l.row[~marked], len(texts)), listed(marks, l.row[at], len(texts))]


def drop_consecutive(rows: DataFrame, value: str, order: list[str], *keys: str) -> DataFrame:
    """rows without those whose value equals the one before, in order, within their key; nulls are equal to each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumns({"_first": F.row_number().over(w) == 1, "_prev": F.lag(value).over(w)})
    return rows.where(F.col("_first") | ~F.col("_prev").eqNullSafe(F.col(value))).drop("_first", "_prev")


def render_trace(nodes: DataFrame, changed: DataFrame, mark: str, *keys: str) -> DataFrame:
    """(keys, rendered): a trace's lines (file, line, text) in order of line, consecutive equal line numbers once, each
    with the mark and three blanks before it if (file, line) has changed."""
    one = drop_consecutive(nodes, "line", ["line", "pos"], *keys)
    hit = one.join(changed.select("file", "line").distinct().withColumn("_c", F.lit(True)), ["file", "line"], "left")
    shown = F.concat(F.when(F.col("_c"), F.lit(f"{mark}   ")).otherwise(F.lit("")), F.col("text"))
    return hit.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", shown.alias("t")))), lambda x: x["t"]), "\n").alias("rendered"))


def first_distinct(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """(keys, value, order): distinct values at their first place."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))


def size_gate(n_pre: Column, n_post: Column, most: int = 10) -> Column:
    """Which files to analyse: `modified` only, where either side has `most` or more, else `all`."""
    return F.when(F.greatest(n_pre, n_post) >= most, "modified").otherwise("all")


def first_fault(diags: DataFrame, ignored: DataFrame, order: str, *keys: str) -> DataFrame:
    """The first diagnostic of each key that counts as a fault.

    diags has level, name, message. Errors count, but not ignored messages, nor undeclared identifiers all in capitals,
    nor the message that there are too many errors. Keys without a fault are left out.
    """
    ident = F.regexp_extract("message", "'(.*?)'", 1)
    constant = F.col("message").startswith("use of undeclared identifier") & (F.upper(ident) == ident) & (F.lower(ident) != ident)
    bad = diags.where((F.col("level") == "Error") & ~constant & ~F.col("message").contains("too many errors emitted"))
    bad = bad.join(ignored.select("message").distinct(), "message", "left_anti")
    return bad.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "message"))).where("_n = 1").drop("_n")


def recover(rows: DataFrame, check: Callable[[str], bool], *keys: str, base: str = "base", pool: str = "pool", rounds: int = 100, patience: int = 5) -> DataFrame:
    """(keys, recovered, text, used): base text with lines of a pool put back until the check passes.

    base and pool are arrays of lines. Lines are added one at a time in the pool's order; the loop ends on success, after
    `rounds` additions, after `patience` additions in a row that changed nothing, or with the pool.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields), "recovered boolean, text string, used int"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                r = dict(zip(pdf.columns, row, strict=True))
                lines = [] if r[base] is None else list(r[base])
                more = [] if r[pool] is None else list(r[pool])
                used = idle = 0
                good = check("\n".join(lines))
                while not good and used < min(rounds, len(more)) and idle < patience:
                    new = more[used]
                    used += 1
                    idle = idle + 1 if new is None or not new.strip() else 0
                    if new is not None:
                        lines.append(new)
                    good = check("\n".join(lines))
                out.append((*[r[k] for k in keys], good, "\n".join(lines), used))
            yield pd.DataFrame(out, columns=[*keys, "recovered", "text", "used"])

    return rows.select(*keys, base, pool).mapInPandas(run, schema)


def concat_diffs(rows: DataFrame, order: str, text: str, *keys: str) -> DataFrame:
    """(keys, diff): texts of a key one after the other, in order; null texts are left out."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))), lambda x: x[text]), "\n").alias("diff"))
