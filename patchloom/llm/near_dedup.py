"""Near-duplicate documents by ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm.components import components, least_labels
from patchloom.llm.shingles import U, chunks, exact_shingles, mix, shingles, tidy

WORDS, SIMILAR = 5, 0.8
#: Bands and registers in each: two texts at similarity 0.8 miss each other with probability 1.5e-5.
BANDS, ROWS = 28, 5
#: Sketches (a byte of each register) that agree in fewer places than this rule a similarity of 0.8 out. A pair at 0.8
#: agrees in each with probability 0.8008; 89 of 140 or more is what all but 2e-6 of such pairs reach, less than what the
#: bands miss. Only texts that did not meet their bucket's first text in one block are compared by sketches at all.
SKETCH_LEAST = 89
#: Members of a bucket, and texts and bytes of texts, that one task compares with as many others.
SKETCHES, TEXTS, TEXT_BYTES = 4096, 1024, 8 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(first: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers, one row of m element hashes for each text; 0 where a text has no element.

    Each element is a Poisson process whose rate is its weight; arrival j falls into a register drawn by (element, j).
    A register keeps the element that arrives first. An element stops as soon as its next arrival comes after the last
    register's first arrival, so heavy texts end early. Registers of two texts agree with probability
    sum over common elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i).
    """
    n = len(first) - 1
    sig = np.zeros((n, m), U)
    at = np.full(n * m, np.inf)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(first))
    w = weight.astype(np.float64)
    t = np.zeros(len(h))
    state = h.copy()
    last = np.full(n, np.inf)
    while len(doc):
        state = mix(state + U(0x9E3779B97F4A7C15))
        t = t - np.log(_unit(state)) / w
        alive = t < last[doc]
        doc, h, w, t, state = doc[alive], h[alive], w[alive], t[alive], state[alive]
        if not len(doc):
            break
        cell = doc * m + (mix(state ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
        np.minimum.at(at, cell, t)
        won = at[cell] == t
        flat[cell[won]] = h[won]
        some = np.unique(doc) if len(doc) < n else np.arange(n)
        last[some] = at.reshape(n, m)[some].max(axis=1)
    return sig


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sets of (sorted hashes, weights); 0 if either is empty."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = float(wa.sum() - x.sum()), float(wb.sum() - y.sum())
    kinds, n = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), k in zip(kinds.T, n, strict=True):
        total += k / (float((np.maximum(kinds[0] / p, kinds[1] / q) * n).sum()) + only_a / p + only_b / q)
    return total


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, id, n_bytes, text) to (k, id, n_bytes, sketch, keys): a byte of each register, and the bands' hashes."""
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for a, b in chunks(texts):
            sig = signatures(*shingles(texts[a:b], WORDS))
            some = sig.any(axis=1)
            keys = np.zeros((b - a, BANDS), U)
            for j in range(ROWS):
                keys = mix(keys * U(31) + sig[:, j::ROWS])
            keys = mix(keys + np.arange(BANDS, dtype=U)).view(np.int64)
            sketch = mix(sig).astype(np.uint8)
            own = [batch.column(i).slice(a, b - a) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([s.tobytes() if o else None for s, o in zip(sketch, some, strict=True)], pa.binary()), pa.array([k if o else None for k, o in zip(keys, some, strict=True)], pa.list_(pa.int64()))],
                ["k", "id", "n_bytes", "sketch", "keys"],
            )
    tidy()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group, from batches in order of their first `keys` columns."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:keys] != rows[0][:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _forest(v: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least member, member) of each component of a symmetric matrix of near pairs."""
    label = least_labels(*np.nonzero(near), len(v))
    at = np.flatnonzero(label != np.arange(len(v)))
    return v[label[at]], v[at]


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """For each two rows how many bytes agree."""
    n, m = x.shape
    out = np.empty((n, n), np.int16)
    step = max(1, (4 << 20) // (n * m))
    for i in range(0, n, step):
        out[i : i + step] = (x[i : i + step, None, :] == x[None, :, :]).sum(axis=2, dtype=np.int16)
    return out


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, i, j, v, comp, sketch) in order of (key, i, j) to links (a, b) that hold close pairs of a bucket together."""
    for rows in _groups(batches, 3):
        v, comp = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        if len(rows) > 1 and (comp != comp[0]).any():
            same = _equal_bytes(np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1))
            yield _links([_forest(v, (same >= SKETCH_LEAST) & (comp[:, None] != comp[None, :]))])


def _shared(first: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each two texts the first one's weight on shingles that both have: products over shingles that two texts have."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    several = times[col] > 1
    doc, col, weight = doc[several], new[col[several]], weight[several]
    order = np.argsort(col, kind="stable")
    doc, col, weight = doc[order], col[order], weight[order]
    out = np.zeros((n, n), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        s, e = np.searchsorted(col, [c, c + 2048])
        has, heavy = (np.zeros((n, 2048), np.float32) for _ in range(2))
        has[doc[s:e], col[s:e] - c] = 1
        heavy[doc[s:e], col[s:e] - c] = weight[s:e]
        out += heavy @ has.T
    return out


def alike(texts: list[str | None], comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest (pairs of places) that holds together texts of probability Jaccard 0.8 or more in different components.

    Shingles are compared word by word, not by hashes. Where all shingles of two texts occur once, similarity follows
    from the number of shared ones. Of others, the share of a text's weight on shared shingles is an upper bound; pairs
    beyond it that nothing holds together yet are compared one by one, likely ones first.
    """
    n = len(texts)
    first, h, c = exact_shingles(texts, WORDS)
    size = np.diff(first)
    total = np.add.reduceat(np.append(c, 0), np.minimum(first[:-1], len(c))) * (size > 0)
    plain = total == size
    other = comp[:, None] != comp[None, :]
    doc = np.repeat(np.arange(n), size)
    share = _shared(first, h, c / total[doc])
    common = share * size[:, None]
    both = plain[:, None] & plain[None, :]
    near = other & both & (common >= (SIMILAR - 1e-6) * (size[:, None] + size[None, :] - common))
    a, b = np.nonzero(np.triu(near, 1))
    if not plain.all():
        bound = np.where(other & ~both, np.minimum(share, share.T), 0.0)
        x, y = np.nonzero(np.triu(bound >= SIMILAR - 1e-4, 1))
        order = np.argsort(-bound[x, y], kind="stable")
        label = least_labels(a, b, n)
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            if label[i] != label[j]:
                p, q = slice(first[i], first[i + 1]), slice(first[j], first[j + 1])
                if likeness((h[p], c[p]), (h[q], c[q])) >= SIMILAR - 1e-9:
                    a, b = np.append(a, i), np.append(b, j)
                    label[label == label[j]] = label[i]
    label = least_labels(a, b, n)
    at = np.flatnonzero(label != np.arange(n))
    return label[at], at


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, i, j, v, comp, text) in order of (group, i, j) to links (a, b) between alike texts of other components."""
    for rows in _groups(batches, 3):
        v, comp = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        if len(rows) > 1 and (comp != comp[0]).any():
            a, b = alike([r[5] for r in rows], comp)
            yield _links([(v[a], v[b])])
    tidy()


def _block(v: str, n: F.Column) -> F.Column:
    """One of n blocks for a member, by a hash of its number."""
    return F.pmod(F.xxhash64(F.lit(5), v), n).cast("int")


def _blocks(rows: DataFrame, n: str, *cols: str) -> DataFrame:
    """Rows of (group, v, ...), each in one of its group's n blocks, to (group, i, j, cols) for every two blocks i <= j."""
    one = rows.withColumn("_b", _block("v", F.col(n))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    return one.select("group", F.least("_b", "_j").alias("i"), F.greatest("_b", "_j").alias("j"), *cols)


def _dealt(rows: DataFrame, n_bytes: float) -> DataFrame:
    return C.sized(rows.repartition("group", "i", "j"), n_bytes, 8, 4 << 20).sortWithinPartitions("group", "i", "j")


def near_classes(docs: DataFrame) -> DataFrame:
    """(_k, _id, class_id, has_words) for each row of docs: its near-duplicate class, named by the class's least doc_id.

    Texts are sets of 5-word shingles (lower case, split at white space) weighted by their counts. Texts are linked if
    their probability Jaccard similarity is 0.8 or more, and linked texts share a class. Equal texts (by the 128 bits of
    their MD5, _id) are one vertex, so copies cost nothing. Columns of docs other than doc_id and text are not looked at.

    1. Texts that share a bucket of equal band hashes with others form stars: each goes to the least vertex that it
       shares a bucket with. A star is dealt to blocks of bounded rows and bytes, its centre to all of them, and
       whatever meets in a block is compared exactly.
    2. Buckets drop out that are in one component by now or all of whose members met in one block. In those left, the
       sketches of members in different components are compared, in every two blocks of a bucket; members with close
       sketches form families, whose texts are compared in the same way.
    No pairs are listed and no task gets more than two blocks. What is lost: pairs at 0.8 that share no bucket, 1.5e-5 of
    them, and among those compared by sketches 2e-6 more; the nearer texts are, the fewer.

    Null text counts as empty. A text without words is in no class but its own: rows with null or empty texts are never
    duplicates. Short texts have one shingle of all their words. Null ids come last and read as the largest id.
    """
    spark, bag = docs.sparkSession, []

    def cut(df: DataFrame, name: str) -> DataFrame:
        return C.cut(df, name, bag)

    x = F.coalesce(F.col("text"), F.lit(""))
    rows = C.prepared(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("k"), F.unhex(F.md5(x)).alias("id"), F.octet_length(x).alias("n_bytes"), x.alias("text"))
    signed = cut(rows.mapInArrow(_sign, "k long, id binary, n_bytes int, sketch binary, keys array<long>"), "sign")
    vertex = signed.where("sketch is not null").groupBy("id").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first(F.struct("sketch", "keys")).alias("s"))
    n = signed.count()
    vertex = C.sized(vertex, 400 * n)
    vertex = cut(vertex.select(F.monotonically_increasing_id().alias("v"), "id", "k", "copies", "n_bytes", "s.*"), "vertex")
    bands = vertex.select("v", "n_bytes", F.explode("keys").alias("key"))
    full = bands.groupBy("key").agg(F.min("v").alias("leader"), F.max("v").alias("last")).where("leader < last").select("key", "leader")
    bands = cut(bands.join(C.side(cut(C.sized(full, 16 * BANDS * n), "full")), "key"), "bands")
    bands = C.compact(bands)
    C.release(spark)
    # stars
    star = bands.groupBy("v").agg(F.min("leader").alias("group"), F.first("n_bytes").alias("n_bytes"))
    star = C.compact(cut(star, "star"))
    size = star.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum("n_bytes") / TEXT_BYTES)).alias("n"))
    star = C.compact(cut(star.join(size, "group").select("v", "group", "n", _block("v", F.col("n")).alias("i")), "star"))
    centre = star.select(F.col("group").alias("v"), "group", "n").distinct().select("v", "group", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    member = cut(star.where("v <> group").select("v", "group", "i").unionByName(centre), "member")
    need = cut(vertex.join(C.side(star.select("v")), "v", "left_semi").select("v", "id", "n_bytes"), "need")
    texts = rows.select("id", "text").join(C.side(need.select("v", "id")), "id").dropDuplicates(["v"]).select("v", F.col("text").alias("x"))
    of = need.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    wide = (of[0] or 0) + 64 * of[1]
    texts = cut(C.sized(texts, wide, 2), "texts")
    met = texts.join(C.side(member), "v").select("group", "i", F.lit(0).alias("j"), "v", F.col("v").alias("comp"), "x")
    links = cut(_dealt(met, 2 * wide).mapInArrow(_compare, "a long, b long"), "links")
    labels = components(links, bag)
    # buckets that are still open
    now = bands.select("key", "v", "leader").join(C.side(labels.withColumnRenamed("id", "v")), "v", "left").join(C.side(star), "v")
    now = cut(now.select("key", "v", "leader", F.coalesce("comp", "v").alias("comp"), "group", "i"), "now")
    head, tail = F.col("v") == F.col("leader"), F.col("v") != F.col("leader")
    sums = {n: f(F.when(w, F.col(c))) for n, f, w, c in (("g0", F.min, tail, "group"), ("g1", F.max, tail, "group"), ("i0", F.min, tail, "i"), ("i1", F.max, tail, "i"), ("hg", F.min, head, "group"), ("hi", F.min, head, "i"))}
    per = C.compact(now).groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.first("leader").alias("l"), F.count(F.lit(1)).alias("m"), *(c.alias(n) for n, c in sums.items()))
    settled = F.expr("c0 = c1 or g0 = g1 and i0 = i1 and (g0 = l or g0 = hg and i0 = hi)")
    mixed = cut(per.where(~settled).select(F.col("key").alias("group"), F.ceil(F.col("m") / SKETCHES).alias("n")), "mixed")
    if not mixed.isEmpty():
        open_ = now.select(F.col("key").alias("group"), "v", "comp").join(C.side(mixed), "group").join(vertex.select("v", "sketch"), "v")
        copies = 200 * (mixed.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) * SKETCHES
        close = cut(_dealt(_blocks(open_, "n", "v", "comp", "sketch"), copies).mapInArrow(_families, "a long, b long"), "near")
        fam = components(close, bag).select(F.col("id").alias("v"), F.col("comp").alias("group"))
        fam = fam.join(vertex.select("v", "n_bytes"), "v").join(C.side(labels.withColumnRenamed("id", "v")), "v", "left").select("v", "group", "n_bytes", F.coalesce("comp", "v").alias("comp"))
        fam = C.compact(cut(fam, "fam"))
        size = fam.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TEXTS), F.ceil(F.sum("n_bytes") / TEXT_BYTES)).alias("n"))
        fam = cut(fam.join(size, "group").select("v", "group", "comp", "n"), "fam")
        copies = (wide / max(1, of[1])) * (fam.agg(F.sum("n")).first()[0] or 0)
        pairs = _dealt(_blocks(texts.join(C.side(fam), "v"), "n", "v", "comp", "x"), copies)
        more = cut(pairs.mapInArrow(_compare, "a long, b long"), "more")
        labels = components(links.unionByName(more), bag)
    # the classes' names; texts of one row without links keep theirs
    linked = labels.join(vertex.select(F.col("v").alias("id"), F.col("id").alias("name"), "k"), "id")
    linked = cut(linked.select("comp", "name", "k"), "linked")
    least = linked.groupBy("comp").agg(F.min("k").alias("class_id"))
    named = C.side(cut(linked.join(least, "comp").select(F.col("name").alias("id"), "class_id"), "named"))
    lone = vertex.where("copies > 1").select("id", F.col("k").alias("class_id")).join(named, "id", "left_anti")
    named = cut(lone.unionByName(named), "named")
    out = signed.join(C.side(named), "id", "left")
    out = out.select(F.col("k").alias("_k"), F.col("id").alias("_id"), F.coalesce("class_id", "k").alias("class_id"), F.col("sketch").isNotNull().alias("has_words"))
    out = C.cut(out, "class")
    C.drop_bag(spark, bag)
    C.release(spark)
    return out


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_classes() of all documents: the class of each, and whether it is the one that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(docs).select(F.when(F.col("_k") != C.NULL_ID, F.col("_k")).alias("doc_id"), "class_id", (F.col("class_id") == F.col("_k")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id (of those, the least text by MD5); documents without words stay."""
    classes = near_classes(docs)
    stay = classes.where((F.col("class_id") == F.col("_k")) | ~F.col("has_words"))
    first = stay.where("has_words").groupBy("_k").agg(F.min("_id").alias("_id"))
    stay = C.cut(first.unionByName(stay.where("not has_words").select("_k", "_id").distinct()), "stay")
    held = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("_k"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("_id"))
    out = held.join(C.side(stay), ["_k", "_id"], "left_semi")
    # rows equal in id and text are copies too
    twice = out.groupBy("_k", "_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (out.dropDuplicates(["_k", "_id"]) if twice else out).select("_row.*")
