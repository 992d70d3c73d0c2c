"""Diff algebra: unified diffs as rows, runs of lines, line and hunk maps.

Keys are column names that identify a pair of texts (patch, file); every operator carries them and partitions by them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import align
from patchloom.functions.batches import batch_lines, latest
from patchloom.session import checkpointed

HEADER_PARTS = r"^@@ -(?P<a0>\d+)(?:,(?P<an>\d+))? \+(?P<b0>\d+)(?:,(?P<bn>\d+))? @@"


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, pos, line): a text's lines, numbered from 0. Null texts have none."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def parse_diff(patches: DataFrame, *keys: str, text: str = "text", compat: bool = False) -> DataFrame:
    """(keys, file_idx, old_file, new_file, pos, side, line_no, text): added and deleted lines with their numbers.

    Counters start at a hunk header's numbers and go on with each line. Headers of files are recognised between hunks
    only, by the hunks' own lengths, and "\\ No newline" lines count nothing. compat counts as simpler tools do: any
    line that starts with +++ or --- is a header that advances both counters, as "\\" lines do.
    A patch without hunks gives no rows; null text neither. Each row is a patch of its own, whose lines never leave its
    task: counters are running sums over the lines of an Arrow batch, so nothing is sorted or shuffled.
    """
    rows = patches.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.select(*keys).schema.fields), PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, columns = changed_lines(batch.column(len(keys)), compat)
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[: len(keys)]), *columns], [*keys, *PARSED_NAMES])

    return rows.mapInArrow(run, schema)


PARSED = "file_idx bigint, old_file string, new_file string, pos int, side string, line_no int, text string"
PARSED_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def changed_lines(texts: pa.Array, compat: bool) -> tuple[pa.Array, list[pa.Array]]:
    """parse_diff() of an array of patches: the place of each changed line's patch, and its columns."""
    l = batch_lines(texts)
    n, at = len(l.text), np.arange(len(l.text))
    begins = lambda x: pc.starts_with(l.text, x).to_numpy(zero_copy_only=False)
    found = at[begins("@@ -")]
    parts = pc.extract_regex(l.text.take(pa.array(found)), HEADER_PARTS)
    found, parts = found[parts.is_valid().to_numpy(zero_copy_only=False)], parts.drop_null()
    num = {}
    for c, default in (("a0", 0), ("an", 1), ("b0", 0), ("bn", 1)):
        x = parts.field(c)
        size = pc.utf8_length(x)
        num[c] = pc.if_else(pc.and_(pc.greater(size, 0), pc.less_equal(size, 9)), x, str(default)).cast(pa.int64()).to_numpy(zero_copy_only=False)
    head = np.zeros(n, bool)
    head[found] = True
    last = latest(head)
    hunk = last >= l.first  # lines of a patch before its first hunk have none
    no = np.where(hunk, np.cumsum(head) - 1, 0)
    a0, an, b0, bn = (x[no] if len(x) else np.zeros(n, np.int64) for x in num.values())
    body = hunk & ~head
    plus, minus = body & (l.lead == ord("+")), body & (l.lead == ord("-"))
    if compat:
        plus, minus = plus & ~begins("+++"), minus & ~begins("---")
        both = body & ~plus & ~minus
    else:
        both = body & ((l.lead == ord(" ")) | (l.lead == 0))
    na, nb = np.cumsum(minus | both), np.cumsum(plus | both)
    na, nb = (x - x[np.where(hunk, last, 0)] if n else x for x in (na, nb))
    inside = np.zeros(n, bool)
    if not compat:
        # of the lines that carry a sign or a blank, those within the hunk's lengths
        inside = body & (na <= an) & (nb <= bn)
        plus, minus = plus & inside, minus & inside
    git = np.cumsum(begins("diff --git "))
    file = git - (git - begins("diff --git "))[l.first] if n else git
    take = np.flatnonzero(plus | minus)
    names = []
    for mark in ("--- ", "+++ "):
        named = begins(mark) & ~inside
        where = latest(named)[take]
        name = pc.replace_substring_regex(l.text.filter(pa.array(named)), r"^(?:---|\+\+\+) (?:[ab]/)?", "")
        names.append(name.take(pa.array((np.cumsum(named) - 1)[take], mask=where < l.first[take])))
    line_no = np.where(plus, b0 - 1 + nb, a0 - 1 + na)[take].astype(np.int32)
    side = pc.if_else(pa.array(plus[take]), "add", "delete")
    return pa.array(l.row[take]), [pa.array(np.maximum(file[take], 1)), *names, pa.array((at - l.first)[take].astype(np.int32)), side, pa.array(line_no), pc.utf8_slice_codeunits(l.text.take(pa.array(take)), 1)]


def split_files(patches: DataFrame, *keys: str, text: str = "text", compat: bool = False) -> DataFrame:
    """(keys, file_idx, section): a patch cut before each `diff --git` line; text before the first belongs to none.

    compat drops the last line of every section but the final one.
    """
    l = lines(patches, text, *keys)
    run = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("file_idx", F.sum(F.col("line").startswith("diff --git").cast("int")).over(run)).where("file_idx > 0")
    if compat:
        per, whole = Window.partitionBy(*keys, "file_idx"), Window.partitionBy(*keys)
        l = l.withColumns({"_last": F.max("pos").over(per), "_of": F.max("file_idx").over(whole)}).where("file_idx = _of or pos < _last")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return l.groupBy(*keys, "file_idx").agg(body.alias("section"))


def _tagged(df: DataFrame, n: str, *keys: str) -> DataFrame:
    """df with grp, the number of the run that each row belongs to; rows without a number are left out."""
    w = Window.partitionBy(*keys).orderBy(n)
    starts = F.coalesce((F.col(n) != F.lag(n).over(w) + 1).cast("int"), F.lit(1))
    return df.where(F.col(n).isNotNull()).withColumn("_s", starts).withColumn("grp", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def runs(df: DataFrame, n: str, *keys: str) -> DataFrame:
    """(keys, grp, run_start, run_end, run_len): maximal runs of consecutive numbers, per key in ascending order.

    A repeated number starts a new run, as the next number is not one more. Nulls are left out.
    """
    return _tagged(df.select(*keys, n), n, *keys).groupBy(*keys, "grp").agg(F.min(n).alias("run_start"), F.max(n).alias("run_end"), F.count(F.lit(1)).alias("run_len"))


def context_pivot(all_lines: DataFrame, modified: DataFrame, *keys: str, n: str = "line_no") -> DataFrame:
    """(keys, n, pivot): lines that are not modified, numbered 1, 2, ... in order: the common text of both sides."""
    w = Window.partitionBy(*keys).orderBy(n)
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, n)])
    both = all_lines.select(*keys, n, F.lit(0).alias("_m")).unionByName(modified.where(known).select(*keys, n, F.lit(1).alias("_m")))
    # both sides in one order, in which a line meets those of its number: one shuffle and one sort, by key
    kept = both.withColumn("_m", F.max("_m").over(w.rangeBetween(Window.currentRow, Window.currentRow))).where("_m = 0")
    return kept.select(*keys, n, F.row_number().over(w).alias("pivot"))


def line_map(a: DataFrame, b: DataFrame, *keys: str, n: str = "line_no") -> DataFrame:
    """(keys, src, dst): lines of two sides with equal pivots."""
    left = a.select(*keys, "pivot", F.col(n).alias("src"))
    return left.join(b.select(*keys, "pivot", F.col(n).alias("dst")), [*keys, "pivot"]).select(*keys, "src", "dst")


def hunk_map(del_runs: DataFrame, add_runs: DataFrame, mapping: DataFrame, *keys: str) -> DataFrame:
    """(keys, a_start, a_end, b_start, b_end): deleted and added runs whose neighbours on both sides map to each other.

    Line 0 maps to line 0. There is no mark after the last line: a run that reaches the end pairs with none.
    """
    m = mapping.select(*keys, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))
    d = del_runs.select(*keys, F.col("run_start").alias("a_start"), F.col("run_end").alias("a_end"))
    a = add_runs.select(*keys, F.col("run_start").alias("b_start"), F.col("run_end").alias("b_end"))
    zero = d.where("a_start = 1").select(*keys, F.lit(1).alias("a_start"), F.lit(1).alias("b_start"))
    before = m.select(*keys, (F.col("src") + 1).alias("a_start"), (F.col("dst") + 1).alias("b_start")).unionByName(zero)
    after = m.select(*keys, (F.col("src") - 1).alias("a_end"), (F.col("dst") - 1).alias("b_end"))
    pairs = d.join(before, [*keys, "a_start"]).join(a, [*keys, "b_start"]).join(after, [*keys, "a_end", "b_end"], "left_semi")
    return pairs.select(*keys, "a_start", "a_end", "b_start", "b_end").distinct()


def invert_map(mapping: DataFrame, *keys: str) -> DataFrame:
    """(keys, dst, src) with one source for each target: the largest, but 0 if 0 maps there."""
    best = F.when(F.min("src") == 0, F.lit(0)).otherwise(F.max("src"))
    return mapping.groupBy(*keys, "dst").agg(best.alias("src"))


#: Positions in a range into which a key is cut, so that no key's rows meet in one task.
RANGE = 65_536


def uncovered(points: DataFrame, spans: DataFrame, *keys: str, n: str, start: str = "run_start", end: str = "run_end", width: int = RANGE) -> DataFrame:
    """Rows of points outside every span [start, end] of their key, whose columns may have any names.

    A sweep instead of a join on a range: points and starts of spans stand in one order, and a point is covered if a span
    that starts no later ends no earlier, which a running maximum of ends tells. Each range of `width` positions is swept
    by itself, and begins with the largest end of the ranges before it, a row a range. Points without a key or a position
    lie in no span; spans without one, or that end before they start, cover nothing.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    known = lambda cols: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in cols], F.lit(True))
    own = points.select(F.struct("*").alias("_row"), *[F.col(k).alias(i) for k, i in zip(keys, ks, strict=True)], F.col(n).alias("_at"), F.lit(1).alias("_kind"))
    whole = known([*ks, "_at"])
    from_ = spans.where(known([*keys, start, end]) & (F.col(start) <= F.col(end)))
    from_ = from_.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), *[F.col(k).alias(i) for k, i in zip(keys, ks, strict=True)], F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end"))
    both = own.where(whole).withColumn("_end", F.lit(None).cast(from_.schema["_end"].dataType)).unionByName(from_).withColumn("_range", F.floor(F.col("_at") / width))
    within = Window.partitionBy(*ks, "_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*ks).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = from_.withColumn("_range", F.floor(F.col("_at") / width)).groupBy(*ks, "_range").agg(F.max("_end").alias("_last"))
    every = both.select(*ks, "_range").distinct().join(carried, [*ks, "_range"], "left").withColumn("_carried", F.max("_last").over(before)).drop("_last")
    swept = both.withColumn("_reach", F.max("_end").over(within)).join(every, [*ks, "_range"])
    left = swept.where((F.col("_kind") == 1) & ~F.coalesce(F.greatest("_reach", "_carried") >= F.col("_at"), F.lit(False)))
    return left.select("_row.*").unionByName(own.where(~whole).select("_row.*"))


def unmapped(add: DataFrame, delete: DataFrame, hunks: DataFrame, *keys: str, n: str = "line_no", compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(added, deleted) lines in no paired hunk. compat looks for them on each other's side."""
    hunks = checkpointed(hunks)  # read by both sides
    a, b = ("a_start", "a_end"), ("b_start", "b_end")
    add_on, del_on = (a, b) if compat else (b, a)
    return uncovered(add, hunks, *keys, n=n, start=add_on[0], end=add_on[1]), uncovered(delete, hunks, *keys, n=n, start=del_on[0], end=del_on[1])


def unpaired(lines: DataFrame, *keys: str, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """(keys, side, line_no): deleted and added lines in no paired hunk, of whole texts; what hunk_map() and unmapped() give.

    lines are all lines of both texts, (keys, side, changed, order): sides are delete for the old and add for the new text,
    a side's lines stand in the given order and are numbered from 1. Changed lines lie in a gap between two kept lines; gaps
    are counted from the text's start, and the line that closes one belongs to it. So runs of both sides pair if they lie
    in one gap that both sides close. One window and one aggregation by the keys: rows dealt out by them are shuffled no more.
    """
    change, deleted = F.coalesce("changed", F.lit(False)), F.col("side") == "delete"
    at = Window.partitionBy(*keys, "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    l = lines.select(*keys, deleted.alias("_d"), change.alias("_c"), F.count(F.lit(1)).over(at).cast("int").alias("_n"), (F.count_if(~change).over(at) - (~change).cast("int")).alias("_gap"))
    # a gap's changed lines of one side are consecutive
    run = lambda side: [f(F.when(F.col("_c") & side, F.col("_n"))) for f in (F.min, F.max)]
    closed = lambda side: F.coalesce(F.max(~F.col("_c") & side), F.lit(False))
    (ds, de), (as_, ae) = run(F.col("_d")), run(~F.col("_d"))
    gaps = l.groupBy(*keys, "_gap").agg(ds.alias("_ds"), de.alias("_de"), as_.alias("_as"), ae.alias("_ae"), (closed(F.col("_d")) & closed(~F.col("_d"))).alias("_both"))
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys], F.lit(True))
    left = gaps.where(~(F.col("_both") & F.col("_ds").isNotNull() & F.col("_as").isNotNull() & known))
    span = lambda side, s, e: F.when(F.col(s).isNotNull(), F.transform(F.sequence(s, e), lambda n: F.struct(F.lit(side).alias("side"), n.alias("line_no"))))
    none = F.array().cast("array<struct<side:string,line_no:int>>")
    return left.select(*keys, F.explode(F.concat(F.coalesce(span("delete", "_ds", "_de"), none), F.coalesce(span("add", "_as", "_ae"), none))).alias("_x")).select(*keys, "_x.*")


def patch_hunks(del_lines: DataFrame, add_lines: DataFrame, mapping: DataFrame, *keys: str) -> DataFrame:
    """(keys, type, a_start, a_end, b_start, b_end, a_code, b_code, insert_line): modified, added and deleted hunks.

    del_lines and add_lines are (keys, line_no, text). A run that pairs is a `mod`, other runs are `del` or `add`; an
    added run is inserted after the source line that the line before it maps back to (null if that line is new too).
    """
    def coded(rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
        """Runs with their lines joined: one pass, as each line is in one run."""
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
        return _tagged(rows.select(*keys, "line_no", "text"), "line_no", *keys).groupBy(*keys, "grp").agg(F.min("line_no").alias(start), F.max("line_no").alias(end), text.alias(name)).drop("grp")

    # each is read more than once below
    mapping = checkpointed(mapping.select(*keys, F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")))
    dc, ac = checkpointed(coded(del_lines, "a_start", "a_end", "a_code")), checkpointed(coded(add_lines, "b_start", "b_end", "b_code"))
    d = dc.select(*keys, F.col("a_start").alias("run_start"), F.col("a_end").alias("run_end"))
    a = ac.select(*keys, F.col("b_start").alias("run_start"), F.col("b_end").alias("run_end"))
    paired = hunk_map(d, a, mapping, *keys)
    # a deleted run is a row of its own unless it pairs; then the row is the pair's
    left = dc.join(paired, [*keys, "a_start", "a_end"], "left").withColumn("type", F.when(F.col("b_start").isNull(), "del").otherwise("mod"))
    both = left.join(ac, [*keys, "b_start", "b_end"], "full")
    back = invert_map(mapping, *keys).select(*keys, (F.col("dst") + 1).alias("b_start"), F.col("src").alias("_back"))
    both = both.withColumn("type", F.coalesce("type", F.lit("add"))).join(back, [*keys, "b_start"], "left")
    line = F.when(F.col("type") == "add", F.when(F.col("b_start") == 1, F.lit(0)).otherwise(F.col("_back"))).cast("int")
    return both.select(*keys, "type", "a_start", "a_end", "b_start", "b_end", "a_code", "b_code", line.alias("insert_line"))


# --- Sequential algorithms, one text or hunk at a time, in Arrow batches ---


def _opcodes(a: list[str], b: list[str], blind: bool) -> list[tuple[str, int, int, int, int]]:
    key = (lambda s: "".join(s.split())) if blind else (lambda s: s)
    return align.opcodes([key(x) for x in a], [key(x) for x in b])


def unified(old: str | None, new: str | None, context: int | str = 3, ignore_space: bool = True, name: str = "file") -> str:
    """A valid unified diff of two texts; lines equal but for white space count as equal unless told otherwise.

    context is a number of lines, "full" for all, or "function": then a hunk reaches back to the line that begins the
    function it lies in and on to the line before the next one begins. A function begins at a line whose first character
    is a letter, _ or $. What is kept follows from the rarest common lines, see align.blocks(); other tools may choose
    other lines among several as good. Equal texts give an empty string; null is an empty text.
    """
    a, b = ([] if not t else t.split("\n") for t in (old, new))
    ops = _opcodes(a, b, ignore_space)
    if all(op[0] == "equal" for op in ops):
        return ""
    begins = [i for i, x in enumerate(a) if x[:1].isalpha() or x[:1] in ("_", "$")] if context == "function" else []

    def before(i: int) -> int:
        """Equal lines to show before a change at line i of the old text."""
        if context == "full":
            return len(a)
        return i - begins[k - 1] if begins and (k := bisect_right(begins, i)) else i if context == "function" else context

    def after(i: int) -> int:
        """Equal lines to show behind a change that ends at line i."""
        if context == "full":
            return len(a)
        return (begins[k] if (k := bisect_left(begins, i)) < len(begins) else len(a)) - i if context == "function" else context

    groups: list[list[tuple[str, int, int, int, int]]] = [[]]
    for at, (tag, i1, i2, j1, j2) in enumerate(ops):
        if tag == "equal":
            behind = after(i1) if at else 0
            ahead = before(i2) if at < len(ops) - 1 else 0
            if behind + ahead < i2 - i1:
                if behind:
                    groups[-1].append((tag, i1, i1 + behind, j1, j1 + behind))
                groups.append([(tag, i2 - ahead, i2, j2 - ahead, j2)] if ahead else [])
                continue
        groups[-1].append((tag, i1, i2, j1, j2))
    out = [f"diff --git a/{name} b/{name}", f"--- a/{name}", f"+++ b/{name}"]
    for g in groups:
        if all(x[0] == "equal" for x in g):
            continue
        i1, i2, j1, j2 = g[0][1], g[-1][2], g[0][3], g[-1][4]
        out.append(f"@@ -{i1 + (i2 > i1)},{i2 - i1} +{j1 + (j2 > j1)},{j2 - j1} @@")
        for tag, a1, a2, b1, b2 in g:
            if tag == "equal":
                out += [" " + x for x in a[a1:a2]]
            else:
                out += ["-" + x for x in a[a1:a2]] + ["+" + x for x in b[b1:b2]]
    return "\n".join(out) + "\n"


def apply_diff(old: str | None, changes: list[tuple[str, int, str]]) -> str | None:
    """old with deleted lines taken out and added lines put in at their target numbers; context is not checked.

    changes are (side, line_no, text). An added line past the end is appended. Null stays null.
    """
    if old is None:
        return None
    gone = {n for s, n, _ in changes if s == "delete"}
    out = [x for i, x in enumerate(old.split("\n") if old else [], 1) if i not in gone]
    for _, n, text in sorted((c for c in changes if c[0] == "add"), key=lambda c: c[1]):
        out.insert(n - 1, text)
    return "\n".join(out)


def apply_patches(files: DataFrame, changes: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, text): apply_diff() of each file with its changes (keys, side, line_no, text); files without any stay."""
    c = changes.groupBy(*keys).agg(F.collect_list(F.struct("side", "line_no", "text")).alias("_c"))
    rows = files.select(*keys, F.col(text).alias("text")).join(c, [*keys], "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keys).schema.fields), "text string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[list(keys)].copy()
            out["text"] = [apply_diff(t, [] if x is None else [(y["side"], y["line_no"], y["text"]) for y in x]) for t, x in zip(pdf["text"], pdf["_c"], strict=True)]
            yield out

    return rows.mapInPandas(run, schema)


def places(a: str) -> dict[str, int]:
    """For each character of a text its places as bits."""
    out: dict[str, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def common_length(at: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of a text of n characters, given by its places(), and b.

    A row of the usual table is one number whose bits are the places where the length does not grow, so each character
    of b costs a few operations on whole rows.
    """
    full = (1 << n) - 1
    row = full
    for y in b:
        if hit := row & at.get(y, 0):
            row = (row + hit | row - hit) & full
    return n - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity by insertions and deletions: 2 * longest common subsequence over the sum of lengths; 1 for two empty texts."""
    return 2.0 * common_length(places(a), len(a), b) / (len(a) + len(b)) if a or b else 1.0


def best_lines(a: list[str | None], b: list[str | None], least: float) -> Iterator[tuple[int, int, float]]:
    """(place in a, place in b, score) of match_lines() for one hunk.

    Equal lines score 1 and nothing else does, so they are found by value. Other pairs are scored only if the lengths, then
    the characters that both have, leave room for a score above the best so far.
    """
    texts = [x or "" for x in b]
    counts = [Counter(x) for x in texts]
    free = dict.fromkeys(range(len(texts)))
    equal: dict[str, deque[int]] = {}
    for j, y in enumerate(texts):
        equal.setdefault(y, deque()).append(j)
    for i, x in enumerate(a):
        x = x or ""
        best, at = least, -1
        same = equal.get(x, ())
        while same and same[0] not in free:
            same.popleft()
        if same and least <= 1.0:
            best, at = 1.0, same[0]
        else:
            bits, own = places(x), Counter(x)
            for j in free:
                total = len(x) + len(texts[j])
                for bound in (lambda: min(len(x), len(texts[j])), lambda: (own & counts[j]).total(), lambda: common_length(bits, len(x), texts[j])):  # noqa: B023
                    score = 2.0 * bound() / total if total else 1.0
                    if score < best or score == best and at >= 0:
                        break
                else:
                    best, at = score, j
        if at >= 0:
            del free[at]
            yield i, at, best


def match_lines(hunks: DataFrame, *keys: str, a: str = "a_lines", b: str = "b_lines", least: float = 0.6) -> DataFrame:
    """(keys, a_idx, b_idx, score): for each line of a, in order, the best line of b not yet taken, if alike enough.

    The first of equally good lines wins; a best line below `least` stays free. Hunks are independent rows, so nothing
    is gathered; the work within one is sequential and runs in Arrow batches.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in hunks.select(*keys).schema.fields), "a_idx int, b_idx int, score double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                r = dict(zip(pdf.columns, row, strict=True))
                x, y = ([] if r[c] is None else list(r[c]) for c in (a, b))
                out += [(*[r[k] for k in keys], *m) for m in best_lines(x, y, least)]
            yield pd.DataFrame(out, columns=[*keys, "a_idx", "b_idx", "score"])

    return hunks.select(*keys, a, b).mapInPandas(run, schema)


def map_statements(pairs: DataFrame, *keys: str, a: str = "a_lines", b: str = "b_lines") -> DataFrame:
    """(keys, kind, a_idx, b_idx): statements of two versions aligned: equal and replaced ones in step, as far as the
    shorter side goes; other deleted ones with null b_idx, inserted ones with null a_idx. What is equal follows from the
    rarest common statements, see align.blocks()."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields), "kind string, a_idx int, b_idx int"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                r = dict(zip(pdf.columns, row, strict=True))
                x, y = ([] if r[c] is None else list(r[c]) for c in (a, b))
                k = [r[c] for c in keys]
                for tag, i1, i2, j1, j2 in align.opcodes(x, y):
                    both = min(i2 - i1, j2 - j1)
                    out += [(*k, tag, i1 + t, j1 + t) for t in range(both)]
                    out += [(*k, "delete", i, None) for i in range(i1 + both, i2)]
                    out += [(*k, "insert", None, j) for j in range(j1 + both, j2)]
            frame = pd.DataFrame(out, columns=[*keys, "kind", "a_idx", "b_idx"])
            yield frame.astype({"a_idx": "Int32", "b_idx": "Int32"})

    return pairs.select(*keys, a, b).mapInPandas(run, schema)


def transform_back(statements: Column, mapping: Column) -> Column:
    """Statements replaced by what a map gives for them, or as they are, joined by line feeds."""
    return F.array_join(F.transform(statements, lambda x: F.coalesce(F.try_element_at(mapping, x), x)), "\n")


def text_diffs(pairs: DataFrame, *keys: str, old: str = "old", new: str = "new", context: int | str = 3) -> DataFrame:
    """(keys, diff): unified() for each row."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields), "diff string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[list(keys)].copy()
            out["diff"] = [unified(x, y, context) for x, y in zip(pdf[old], pdf[new], strict=True)]
            yield out

    return pairs.select(*keys, old, new).mapInPandas(run, schema)
