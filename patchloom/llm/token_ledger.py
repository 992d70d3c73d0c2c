"""Token counts in rollups that are maintained by deltas."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm import sentence_pieces as S
from patchloom.llm.mixing import word_count
from patchloom.llm.shingles import column_parts
from patchloom.session import prepared

KEYS = ["source", "lang", "version"]
SUMS = ["n_docs", "n_tokens"]
#: Versions of tokenizers that are counted: words as the mix counts them, and the pieces of the public model.
WORDS, PIECES = "words-1", "piece-bpe-32k"


def counted(docs: DataFrame, model: str = S.MODEL) -> DataFrame:
    """docs without text, with n_words and n_pieces: whole texts, 0 for null."""
    from pyspark.sql import types as T

    path = S.model_path(model)
    docs = docs.withColumn("n_words", word_count(F.col("text")))
    own = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = S.pieces(path, S.ALPHA)
        for batch in batches:
            names = batch.schema.names
            n = [len(x) for _, _, texts in column_parts(batch.column(names.index("text")), S.CHUNK) for x in S.encode(m, texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in own), pa.array(n, pa.int64())], [*own, "n_pieces"])

    return docs.select(*own, "text").mapInArrow(run, T.StructType([f for f in docs.select(*own).schema.fields] + [T.StructField("n_pieces", T.LongType())]))


class TokenLedger:
    """Totals of documents and tokens by source, language and tokenizer version, in a folder of deltas.

    A batch of changes becomes one delta: its signed sums by key, a row a key however many changes there were. A delta
    counts once its folder has been committed; committing a batch id again does nothing, whatever its rows, so a batch
    can be sent again after any failure. Totals are the sum of committed deltas, and compact() replaces many by one that
    remembers their ids. Nulls in a key are a key of their own; keys whose sums are all 0 are left out of totals.
    One writer at a time is assumed, as the folder has no lock.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _folders(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        return sorted(n for n in names if n.startswith("delta-") and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    def _live(self) -> list[str]:
        """Committed folders, without those that a compaction has taken over."""
        found = self._folders()
        over: set[str] = set()
        for n in found:
            if n.startswith("delta-compact-"):
                over |= {r["folder"] for r in self.spark.read.parquet(f"{self.path}/{n.replace('delta-', 'merged-')}").collect()}
        return [n for n in found if n not in over]

    def _name(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch) or batch.startswith("compact-"):
            raise ValueError("a batch id consists of letters, digits and _ . -")
        return f"delta-{batch}"

    @staticmethod
    def signed(changes: DataFrame) -> DataFrame:
        """Changes as signed rows (source, lang, version, n_docs, n_tokens).

        changes has kind (insert, delete or revise), source, lang, version, n_tokens, and for revise the former values
        old_source, old_lang, old_version, old_n_tokens. An insert adds, a delete takes away, a revision does both.
        Null counts are 0. Another kind raises an error when the rows are computed.
        """
        names = [*KEYS, "n_tokens"]
        old = F.struct(*[(F.col(f"old_{c}") if f"old_{c}" in changes.columns else F.lit(None).cast(changes.schema[c].dataType)).alias(c) for c in names], F.lit(-1).alias("sign"))
        now = F.struct(*[F.col(c) for c in names], F.when(F.col("kind") == "delete", F.lit(-1)).otherwise(F.lit(1)).alias("sign"))
        known = F.col("kind").isin("insert", "delete", "revise")
        rows = F.when(F.col("kind") == "revise", F.array(old, now)).when(known, F.array(now)).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))))
        x = changes.select(F.explode(rows).alias("x")).select("x.*")
        return x.select(*KEYS, F.col("sign").cast("long").alias("n_docs"), (F.coalesce("n_tokens", F.lit(0)).cast("long") * F.col("sign")).alias("n_tokens"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch's delta, and says whether it was new. Summed before the shuffle: a hot source costs a row a task."""
        name = self._name(batch)
        merged = {r["folder"] for n in self._folders() if n.startswith("delta-compact-") for r in self.spark.read.parquet(f"{self.path}/{n.replace('delta-', 'merged-')}").collect()}
        if name in merged or self._fs.exists(self._at(f"{name}/_SUCCESS")):
            return False
        sums = self.signed(changes).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, version string, n_docs long, n_tokens long")
        rows = self.spark.read.parquet(*[f"{self.path}/{n}" for n in live])
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Puts one delta in the place of all. The list of what it takes over is written first and counts only with it."""
        live = self._live()
        if len(live) < 2:
            return
        every = {n for n in live} | {r["folder"] for n in live if n.startswith("delta-compact-") for r in self.spark.read.parquet(f"{self.path}/{n.replace('delta-', 'merged-')}").collect()}
        tag = f"compact-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n,) for n in sorted(every)], "folder string").coalesce(1).write.parquet(f"{self.path}/merged-{tag}")
        self.totals().write.parquet(f"{self.path}/delta-{tag}")


def op8_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all documents, copies and null texts too: one batch inserts every document's words and pieces, one
    takes the documents of odd id away and one brings them back, one revises every language to lower case, and two are
    sent again. The totals are those of all rows of the table."""
    docs = prepared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = C.cut(counted(docs.select(F.col("doc_id").cast("long").alias("_k"), "source", "lang", "text")), "counts", bag := [])
    each = F.explode(F.array(F.struct(F.lit(WORDS).alias("version"), F.col("n_words").alias("n_tokens")), F.struct(F.lit(PIECES).alias("version"), F.col("n_pieces").alias("n_tokens"))))
    rows = n.select("_k", "source", "lang", each.alias("v")).select("_k", "source", "lang", "v.*")
    ledger = TokenLedger(spark, f"{C.shared_dir(spark)}/patchloom/ledger-{uuid.uuid4().hex}")
    load = rows.withColumn("kind", F.lit("insert"))
    odd = rows.where(F.col("_k").bitwiseAND(F.lit(1)) == 1)
    taken, back = (odd.withColumn("kind", F.lit(kind)) for kind in ("delete", "insert"))
    old = {f"old_{c}": F.col(c) for c in [*KEYS, "n_tokens"]}
    revised = rows.withColumns({**old, "kind": F.lit("revise")}).withColumn("lang", F.lower("lang"))
    for batch, changes in (("load", load), ("taken", taken), ("taken", taken), ("back", back), ("languages", revised), ("load", load)):
        ledger.commit(batch, changes)
    C.drop_bag(spark, bag)
    return ledger.totals()
