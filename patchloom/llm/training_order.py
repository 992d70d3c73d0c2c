"""Training-order materialisation: token sequences in permuted order, in shards of fixed stride."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm import sentence_pieces as S
from patchloom.llm.shingles import U, column_parts, mix

#: Tokens in a sequence, sequences in a shard, rounds of the permutation.
LENGTH, SHARD, ROUNDS = 512, 2048, 6
#: Characters tokenized at once.
CHUNK = 1 << 20


def feistel(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, or its inverse: a balanced Feistel network over the least even number of bits
    that holds n, walked along its cycles until the result is below n again."""
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = max(1, -(-(int(n) - 1).bit_length() // 2))
    low = U((1 << half) - 1)
    keys = [mix(np.array([(key * 0x9E3779B97F4A7C15 + r) % (1 << 64)], U))[0] for r in range(ROUNDS)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> U(half), v & low
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (mix(left + k) & low), left
            else:
                left, right = right, left ^ (mix(right + k) & low)
        return (left << U(half)) | right

    out = once(x.astype(np.int64).view(U))
    outside = np.flatnonzero(out >= U(n))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= U(n)]
    return out.view(np.int64)


def stride(length: int, wide: bool) -> int:
    """Bytes of a record: the number of its tokens (4 bytes), then its tokens of 2 or 4 bytes, padded with zeros."""
    return 4 + length * (4 if wide else 2)


def tokenized(docs: DataFrame, model: str = S.MODEL) -> DataFrame:
    """docs (any columns, with text) without text, with n_tokens and ids, little-endian, 2 bytes each where the vocabulary allows."""
    from pyspark.sql import types as T

    path, own = S.model_path(model), [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = S.pieces(path, S.ALPHA)
        kind = "<u2" if m.sp.get_piece_size() <= 1 << 16 else "<u4"
        for batch in batches:
            names = batch.schema.names
            for a, b, texts in column_parts(batch.column(names.index("text")), CHUNK):
                ids = S.encode(m, texts)
                part = batch.slice(a, b - a)
                cols = [part.column(names.index(c)) for c in own]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], [*own, "n_tokens", "ids"])

    new = T._parse_datatype_string("n_tokens long, ids binary")
    return docs.select(*own, "text").mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != "text"] + new.fields))


def plan(docs: DataFrame, length: int, model: str, at: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(tokens of documents, number of each document's first sequence, number of sequences); see materialise().

    Both tables are kept in the folder `at`, if given, and read from there where an earlier call has finished them.
    """
    spark = docs.sparkSession

    def kept(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if at is None:
            return C.cut(make(), name)
        if not exists(spark, f"{at}/{name}/_SUCCESS"):
            make().write.mode("overwrite").parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    # rows are told apart by a number that the written table keeps, so that copies have places of their own
    tokens = kept("tokens", lambda: tokenized(C.prepared(docs).select(*C.identity(), "text"), model).withColumn("_u", F.monotonically_increasing_id()))

    def numbered() -> DataFrame:
        slim = tokens.where("n_tokens > 0").select("_k", "_t", "_u", F.ceil(F.col("n_tokens") / length).cast("long").alias("_s"))
        index, _ = C.dense_index(slim, [F.col("_k"), F.col("_t"), F.col("_u")])
        # running sum in two levels: over blocks of documents, then within each
        index = C.cut(index.withColumn("_b", F.floor(F.col("_i") / 4096)), "order")
        blocks = index.groupBy("_b").agg(F.sum("_s").alias("_n")).withColumn("_c", F.floor(F.col("_b") / 4096))
        outer = blocks.groupBy("_c").agg(F.sum("_n").alias("_m"))
        outer = outer.withColumn("_outer", F.coalesce(F.sum("_m").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_c", "_outer")
        blocks = blocks.join(outer, "_c").withColumn("_before", F.col("_outer") + F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.coalesce(F.sum("_s").over(Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return index.join(blocks.select("_b", "_before"), "_b").select("_u", "_s", (F.col("_before") + within).alias("_base"))

    base = kept("base", numbered)
    return tokens, base.drop("_s"), int(base.agg(F.sum("_s")).first()[0] or 0)


def materialise(docs: DataFrame, key: int = 4, length: int = LENGTH, per_shard: int = SHARD, model: str = S.MODEL, only: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """Shards in training order: (shard, first_slot, n_sequences, stride, n_tokens, doc_ids, payload, sha256).

    A document's tokens are cut into sequences of `length`, the last one padded; documents without tokens have none.
    Sequences are numbered in order of (doc_id, place), by a distributed running sum over documents, and a keyed
    permutation of these numbers gives each its slot: all slots 0 .. N - 1, each once. Shard s holds slots s * per_shard
    to (s + 1) * per_shard - 1 in order, as records of one stride, so that slot x lies at
    (x mod per_shard) * stride of its shard: a reader needs no index, and can stop and go on at any slot. Only the last
    shard may hold fewer. doc_ids has the document of each record.

    Ranges of slots are partitions, and shards only need their own, so work lost with an executor is done again for its
    shards alone; `only`, a table with a column shard, makes just these (those missing after an interrupted run: see
    write_shards()). `at` names a folder that keeps the plan, for calls that make a part each.

    Null text has no tokens; null ids come last, as null in doc_ids. Rows equal in id and text, such as the copies that a
    mix makes, have sequences and slots of their own, one after the other in number. Empty in, empty out. Other columns
    of docs are not used.
    """
    tokens, base, total = plan(docs, length, model, at)
    wide_ = S.pieces(S.model_path(model), S.ALPHA).sp.get_piece_size() > 1 << 16
    step = stride(length, wide_)
    width = 4 if wide_ else 2
    shards = -(-total // per_shard)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, first, ids = (batch.column(i).to_pylist() for i in range(3))
            number, doc, body = [], [], []
            for d, b, raw in zip(k, first, ids, strict=True):
                for j, at in enumerate(range(0, len(raw), length * width)):
                    part = raw[at : at + length * width]
                    number.append(b + j)
                    doc.append(d)
                    body.append((len(part) // width).to_bytes(4, "little") + part.ljust(length * width, b"\0"))
            slot = feistel(np.array(number, np.int64), total, key)
            yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array(doc, pa.int64()), pa.array(body, pa.binary())], ["shard", "slot", "doc", "body"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(s: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            docs_ = [None if d == C.NULL_ID else d for _, d, _ in rows]
            bodies = [body for _, _, body in rows]
            count = sum(int.from_bytes(body[:4], "little") for body in bodies)
            payload = b"".join(bodies)
            return pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([s * per_shard], pa.int64()), pa.array([len(docs_)], pa.int32()), pa.array([step], pa.int32()), pa.array([count], pa.int64()),
                 pa.array([docs_], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([hashlib.sha256(payload).hexdigest()])],
                ["shard", "first_slot", "n_sequences", "stride", "n_tokens", "doc_ids", "payload", "sha256"])

        now, rows = None, []
        for batch in batches:
            for s, slot, d, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now and rows:
                    yield out(now, rows)
                    rows = []
                now = s
                rows.append((slot, d, body))
        if rows:
            yield out(now, rows)

    rows = tokens.join(C.side(base), "_u").select("_k", "_base", "ids").mapInArrow(records, "shard int, slot long, doc long, body binary")
    if only is not None:
        rows = rows.join(C.side(C.cut(only.select("shard").distinct(), "only")), "shard", "left_semi")
    parts = max(1, min(shards, max(12, -(-total * step // (32 << 20)))))
    range_ = F.floor(F.col("shard") * F.lit(parts) / F.lit(max(1, shards))).cast("int")
    dealt = rows.repartitionById(parts, range_).sortWithinPartitions("slot")
    return dealt.mapInArrow(shard, "shard int, first_slot long, n_sequences int, stride int, n_tokens long, doc_ids array<long>, payload binary, sha256 string")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_shards(docs: DataFrame, path: str, per_wave: int = 4096, length: int = LENGTH, per_shard: int = SHARD, model: str = S.MODEL, **options) -> DataFrame:
    """Writes the shards that path does not hold yet, and gives the table at path.

    Shards are written in waves of per_wave, a committed folder each, after the plan (tokens and the order of documents),
    which is kept beside them. A call that follows an interrupted one, with the same arguments, makes only what is
    missing: the plan if that broke off, and the shards of waves that are not committed.
    """
    spark = docs.sparkSession
    total = plan(docs, length, model, f"{path}/_plan")[2]
    shards = -(-total // per_shard)
    for wave in range(max(1, -(-shards // per_wave))):
        folder = f"{path}/wave={wave}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            only = spark.range(wave * per_wave, min(shards, (wave + 1) * per_wave)).select(F.col("id").cast("int").alias("shard"))
            materialise(docs, length=length, per_shard=per_shard, model=model, only=only, at=f"{path}/_plan", **options).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(path).drop("wave")


def read_slots(shards: DataFrame, start: int, count: int, per_shard: int = SHARD, wide: bool = False) -> DataFrame:
    """(slot, doc_id, tokens) of slots start .. start + count - 1, from the shards that hold them only."""
    first, last = start // per_shard, (start + count - 1) // per_shard
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lo, hi = max(start, row["first_slot"]), min(start + count, row["first_slot"] + row["n_sequences"])
                at = range(lo - row["first_slot"], hi - row["first_slot"])
                recs = [row["payload"][i * row["stride"] : (i + 1) * row["stride"]] for i in at]
                toks = [np.frombuffer(r[4:], kind)[: int.from_bytes(r[:4], "little")].astype(np.int32) for r in recs]
                yield pa.RecordBatch.from_arrays([pa.array(list(range(lo, hi)), pa.int64()), pa.array([row["doc_ids"][i] for i in at], pa.int64()), pa.array(toks, pa.list_(pa.int32()))], ["slot", "doc_id", "tokens"])

    need = shards.where(F.col("shard").between(first, last)).select("first_slot", "n_sequences", "stride", "doc_ids", "payload")
    return need.mapInArrow(run, "slot long, doc_id long, tokens array<int>")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """materialise() over all documents."""
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
