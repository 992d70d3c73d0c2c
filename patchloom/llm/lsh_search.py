"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm import common as C
from patchloom.session import prepared

#: Tables, and buckets of a table at most.
TABLES, BUCKETS = 2, 1 << 18
#: Vectors drawn to choose the slots' width and the distances to expect: the only bound on what is looked at.
SAMPLE = 4000
#: Estimated probability, over all tables, with which a neighbour at the expected distance is to be met.
SUCCESS = 0.97
#: Vectors that one task compares at once, and queries it compares them with.
BLOCK, QUERIES = 16_000, 16_000
#: Queries whose products with a block are held at once.
STEP = 128


def shape(total: int) -> tuple[int, int]:
    """(functions, slots): hash functions a table and buckets that each tells apart, for so many vectors.

    Four functions up to a hundred thousand vectors and one more for each eight times as many, so that buckets grow much
    slower than the table; slots are a power of two, as many as BUCKETS allow.
    """
    functions = min(9, 4 + max(0, math.floor(math.log(max(total, 1) / 1e5, 8) + 1)))
    slots = 16
    while slots**functions > BUCKETS:
        slots //= 2
    return functions, slots


class Index:
    """Hash functions floor((a . x + b) / width), clipped to some slots (see shape()), over vectors lengthened by one coordinate.

    Largest inner product becomes nearest neighbour: a stored vector gets sqrt(top ** 2 - |x| ** 2) as last coordinate,
    top being the largest norm, a query gets 0. All stored vectors then have one norm, and distance falls with the
    inner product.
    """

    def __init__(self, sample: np.ndarray, top: float, k: int, total: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1] + 1
        self.functions, self.slots_ = shape(total)
        self.top = top
        self.a = rng.standard_normal((TABLES * self.functions, dim))
        spread = float(np.std(self.stored(sample) @ self.a.T, axis=0).mean()) or 1.0
        self.width = spread
        self.b = rng.uniform(0, self.width, TABLES * self.functions)
        self.mid = np.floor((self.stored(sample).mean(axis=0) @ self.a.T + self.b) / self.width).astype(np.int64)
        self.k, self.total, self.sample = k, total, sample

    def stored(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, last[:, None]])

    def slots(self, p: np.ndarray) -> np.ndarray:
        """Slot numbers from 0 of projected vectors; the outer slots reach to infinity."""
        return np.clip(np.floor((p + self.b) / self.width).astype(np.int64) - self.mid + self.slots_ // 2, 0, self.slots_ - 1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket number in each table of stored vectors: (n, TABLES)."""
        s = self.slots(self.stored(x) @ self.a.T).reshape(len(x), TABLES, self.functions)
        return (s * self.slots_ ** np.arange(self.functions)).sum(axis=2) + np.arange(TABLES) * self.slots_**self.functions

    def expected(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share, deviation): where a query's k nearest project to, as a share of its own projection and a spread around it.

        The inner product to expect is that with the query's nearest among the sample, as many as k of all make there and
        one more. A vector of norm top with this inner product lies along the query by it, and anyhow across it.
        """
        near = min(len(self.sample), 1 + math.ceil(self.k * len(self.sample) / max(1, self.total)))
        best = np.empty(len(q))
        for i in range(0, len(q), 512):
            ip = q[i : i + 512] @ self.sample.T
            best[i : i + 512] = np.partition(ip, ip.shape[1] - near, axis=1)[:, ip.shape[1] - near]
        square = (q * q).sum(axis=1)
        return best / square, np.sqrt(np.maximum(self.top**2 - best**2 / square, 1e-12 * self.top**2))

    def probes(self, q: np.ndarray, occupied: np.ndarray) -> list[np.ndarray]:
        """For each query the buckets to visit: in each table in order of estimated success, until SUCCESS is met.

        Success of a slot: the probability of a normal around the expected place, see expected(); a bucket's is the
        product over the functions. Only buckets that hold vectors are returned.
        """
        share, r = self.expected(q)
        p = (np.hstack([q, np.zeros((len(q), 1))]) @ self.a.T) * share[:, None]
        edges = (np.arange(1, self.slots_)[None, :] - self.slots_ // 2 + self.mid[:, None]) * self.width - self.b[:, None]
        goal = 1 - (1 - SUCCESS) ** (1 / TABLES)
        out = []
        for i in range(len(q)):
            cdf = np.array([[0.5 * math.erfc(-z / math.sqrt(2)) for z in row] for row in (edges - p[i][:, None]) / r[i]])
            prob = np.diff(np.hstack([np.zeros((len(cdf), 1)), cdf, np.ones((len(cdf), 1))]), axis=1)
            mine = []
            for t in range(TABLES):
                mine += self._best_first(prob[t * self.functions : (t + 1) * self.functions], goal, t * self.slots_**self.functions)
            out.append(np.array([x for x in mine if occupied[x]], np.int64))
        return out

    @staticmethod
    def _best_first(prob: np.ndarray, goal: float, base: int) -> list[int]:
        """Buckets of one table in descending probability, until they sum to the goal: each function's slots are sorted,
        and a heap walks from the best combination to those with one slot exchanged for the next."""
        order = np.argsort(-prob, axis=1, kind="stable")
        ranked = np.take_along_axis(prob, order, axis=1)
        logs = np.log(np.maximum(ranked, 1e-300))
        k, slots = prob.shape
        start = (0,) * k
        heap, met, found = [(-float(logs[:, 0].sum()), start)], 0.0, []
        while heap and met < goal:
            cost, at = heapq.heappop(heap)
            found.append(base + int(sum(int(order[j, at[j]]) * slots**j for j in range(k))))
            met += math.exp(-cost)
            for j in range(k):
                if at[j] + 1 < slots:
                    heapq.heappush(heap, (cost + float(logs[j, at[j]] - logs[j, at[j] + 1]), (*at[:j], at[j] + 1, *at[j + 1 :])))
                if at[j]:
                    break
        return found


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and holds neither nulls nor numbers that aren't finite; as doubles."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return prepared(df).where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn("_v", v)


def close(q: np.ndarray, x: np.ndarray, visits: list[list[int]], size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """For each query the rows of x that can be among its `most` nearest, of the buckets that it visits.

    x holds the buckets one after another, of these sizes; visits are their places. Products are one matrix for STEP
    queries, in which rows of other buckets count as farthest, so no query copies the rows that it is compared with. All
    rows visited are given if they are no more than `most` or a product is not finite.
    """
    large, largest = np.abs(x).max(), np.abs(q).max(axis=1)
    for s in range(0, len(q), STEP):
        rough = q[s : s + STEP] @ x.T
        seen = np.zeros((len(rough), len(size)), bool)
        for i, mine in enumerate(visits[s : s + STEP]):
            seen[i, mine] = True
        few = ~np.isfinite(rough).all(axis=1) | (seen @ size <= most)
        rough[~np.repeat(seen, size, axis=1)] = -np.inf
        at = max(0, len(x) - most)
        kth = np.partition(rough, at, axis=1)[:, at]
        least = kth - 1e-9 * np.abs(kth) - 1e-12 * q.shape[1] * largest[s : s + STEP] * large
        for i in range(len(rough)):
            if few[i] or not np.isfinite(least[i]):
                yield np.flatnonzero(np.repeat(seen[i], size))
            else:
                yield np.flatnonzero(rough[i] >= least[i])


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", seed: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows by inner product, in double precision.

    rows and queries have an id and a vector; a query's own id is no answer to it. Ties go to the smaller id. Vectors
    that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows with a null id. A query meets
    rows of its own length; those of another length than most are compared with all of theirs. Rows equal in id and
    vector are one. Scores are sums of products of the original components, whatever their size: only the hash functions
    look at scaled vectors, all by one power of two, a query by its own. Where a sum leaves double precision on its way, it
    is taken over scaled vectors and scaled back; if it is infinite then, ranks go by how far it is beyond the range.
    Only id and vector are looked at.

    1. The hash functions are fitted on a bounded sample. All rows are hashed into TABLES tables; of equal vectors only
       the k + 1 with the least ids are stored, as no other can be among a query's first k.
    2. Buckets are dealt to blocks of about BLOCK vectors; one with more is cut into several. The number of buckets is
       bounded by the parameters, so the plan of blocks fits the driver at any input.
       Queries are dealt to parts of about QUERIES, and each block meets each part.
    3. A query visits buckets in order of estimated success. It goes to each block that holds one of them, which ranks
       its vectors there exactly; the blocks' best are merged. Every vector of a visited bucket is compared: there is
       no cap on candidates.
    A query for which too little has been met (fewer than k rows) is compared with all rows, in blocks.
    """
    spark = rows.sparkSession
    base = usable(rows, vector).where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), "_v")
    ask = usable(queries, vector).where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("query_id"), "_v").distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    # a copy's (k + 2)th row could only be among the first k if a query were all of the others
    alike = Window.partitionBy("_h", "_v").orderBy("vec_id")
    base = base.distinct().withColumn("_h", F.xxhash64("_v")).withColumn("_c", F.row_number().over(alike)).where(F.col("_c") <= k + 1).select("vec_id", "_v")
    base = C.cut(base, "vectors")
    most = base.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dim, total = most["d"], most["n"]
    every_length, all_asked = base, ask
    # hashing looks at vectors times one power of two, so that squares stay within the range
    shift = max(-1000, math.frexp(base.agg(F.max(F.array_max(F.transform("_v", lambda x: F.abs(x))))).first()[0])[1])
    base, ask = every_length.where(F.size("_v") == dim), all_asked.where(F.size("_v") == dim)
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.pow(x * F.lit(math.ldexp(1.0, -shift)), 2)))
    top = base.agg(F.max(norm)).first()[0]
    drawn = base.where(C.hash_unit("vec_id", seed=seed) < min(1.0, SAMPLE / total)).limit(4 * SAMPLE).toPandas()
    if not len(drawn):
        drawn = base.limit(SAMPLE).toPandas()
    index = Index(np.ldexp(np.array(drawn.sort_values("vec_id")["_v"].tolist(), np.float64), -shift), max(float(top), 1e-150), k, total, seed)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)

    def mantissas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors times powers of two such that the largest component of each is about one, and these powers."""
        e = np.frexp(np.abs(x).max(axis=1))[1]
        return np.ldexp(x, -e[:, None]), e

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = index.buckets(np.ldexp(matrix(batch.column(1)), -shift)) if batch.num_rows else np.zeros((0, TABLES), np.int64)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(b[:, t].astype(np.int32)), *batch.columns], ["bucket", "vec_id", "_v"])

    stored = base.mapInArrow(hashed, T.StructType([T.StructField("bucket", T.IntegerType()), *base.schema.fields]))
    counts = {r["bucket"]: r["n"] for r in stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    occupied = np.zeros(TABLES * index.slots_**index.functions, bool)
    first, parts = np.zeros(len(occupied), np.int64), np.zeros(len(occupied), np.int64)
    block, room = 0, BLOCK
    for b in sorted(counts):
        occupied[b], n = True, counts[b]
        if n > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first[b], parts[b] = block, max(1, -(-n // BLOCK))
        if parts[b] > 1:
            block, room = block + int(parts[b]), BLOCK
        else:
            room -= n
    blocks = block + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashed(batches):
            b, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = first[b] + (v % np.maximum(parts[b], 1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], ["block", "bucket", "vec_id", "_v"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_, at, lists = [], [], []
            for i, probes in enumerate(index.probes(mantissas(matrix(batch.column(1)))[0], occupied)):
                to: dict[int, list[int]] = {}
                for b in probes.tolist():
                    for x in range(first[b], first[b] + parts[b]):
                        to.setdefault(x, []).append(b)
                for x, bs in to.items():
                    rows_.append(i)
                    at.append(x)
                    lists.append(bs)
            take = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(lists, pa.list_(pa.int32())), batch.column(0).take(take), batch.column(1).take(take)], ["block", "probes", "query_id", "_v"])

    def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products summed from the first coordinate to the last: equal vectors get equal scores."""
        return np.cumsum(q * x, axis=1)[:, -1] + 0.0

    def best(qid: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, near: np.ndarray) -> list[tuple[int, int, float, float]]:
        near = near[np.unique(ids[near], return_index=True)[1]]
        near = near[ids[near] != qid]
        s, over = exact(q, x[near]), np.zeros(len(near))
        bad = np.flatnonzero(~np.isfinite(s))
        if len(bad):
            (qs, eq), (xs, ex) = mantissas(q[None]), mantissas(x[near[bad]])
            scaled = exact(qs[0], xs)
            s[bad] = np.ldexp(scaled, ex + eq)
            m, e = np.frexp(scaled)
            over[bad] = np.where(np.isinf(s[bad]), np.sign(m) * (e + ex + eq + np.log2(np.abs(m) + (m == 0))), 0.0)
        order = np.lexsort((ids[near], -over, -s))[:k]
        return [(qid, int(ids[near[o]]), float(s[o]), float(over[o])) for o in order]

    def ranked(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            return ranked_here(left, right)

    def ranked_here(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float, float]] = []
        if left.num_rows and right.num_rows:
            bucket, ids = left["bucket"].to_numpy(), left["vec_id"].to_numpy()
            x = matrix(left["_v"].combine_chunks())
            order = np.argsort(bucket, kind="stable")
            bucket, ids, x = bucket[order], ids[order], x[order]
            kinds, begin = np.unique(bucket, return_index=True)
            place = {int(b): i for i, b in enumerate(kinds)}
            qids, q, lists = right["query_id"].to_pylist(), matrix(right["_v"].combine_chunks()), right["probes"].to_pylist()
            size = np.diff(np.append(begin, len(bucket)))
            visits = [[place[b] for b in mine if b in place] for mine in lists]
            # a vector can stand here once for each table
            for i, near in enumerate(close(q, x, visits, size, TABLES * (k + 1))):
                out += best(qids[i], q[i], ids, x, near)
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], ["query_id", "vec_id", "score", "over"])

    cand = "query_id long, vec_id long, score double, over double"

    def compared(left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
        """Candidates of blocks (d, block, bucket, vec_id, _v) and their queries (d, block, probes, query_id, _v)."""
        parts = max(1, -(-asked_n // QUERIES))
        keys = ["d", "block", "part"]
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else left.withColumn("part", F.lit(0))
        right = right.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        left, right = (x.repartition(blocks * parts, *keys).select(*keys, *[c for c in x.columns if c not in keys]) for x in (left, right))
        pick = lambda x: [x[c] for c in keys]
        return left.groupBy(*pick(left)).cogroup(right.groupBy(*pick(right))).applyInArrow(ranked, cand)

    def top_k(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("over").desc(), "vec_id")
        return df.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked_n = all_asked.count()
    left = base.mapInArrow(dealt, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("bucket", T.IntegerType()), *base.schema.fields])).withColumn("d", F.lit(dim))
    right = ask.mapInArrow(asked, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("probes", T.ArrayType(T.IntegerType())), *ask.schema.fields])).withColumn("d", F.lit(dim))
    done = C.cut(top_k(compared(left, right, blocks)), "nearest")
    # where the buckets held too few, or vectors have another length, all rows of the length are looked at in blocks
    lengths = C.cut(every_length.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("deal")), "lengths")
    enough = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    short = all_asked.withColumn("d", F.size("_v")).join(C.side(lengths), "d").join(enough, "query_id", "left")
    short = C.cut(short.where(F.coalesce("m", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("query_id", "_v", "d", "deal"), "short")
    asked_n = short.count()
    if asked_n:
        wanted = short.select("d", "deal").distinct()
        every = every_length.withColumn("d", F.size("_v")).join(F.broadcast(wanted) if asked_n < 1 << 20 else wanted, "d")
        every = every.select("d", F.pmod(F.col("vec_id"), F.col("deal")).cast("int").alias("block"), F.lit(0).alias("bucket"), "vec_id", "_v")
        again = short.select("d", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("block"), F.array(F.lit(0)).alias("probes"), "query_id", "_v")
        rest = top_k(compared(every, again, wanted.agg(F.sum("deal")).first()[0]))
        done = done.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
    return done


def op6_lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all embeddings for those whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
