"""What the training-data operators share: lineage cuts, size-checked joins, row identity, dense ranks."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.session import prepared

#: A side of a join is broadcast only when its measured size stays below this.
BROADCAST_BYTES = 64 << 20
#: Stands for a null id where ids are ordered: null ids come last.
NULL_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='patchloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "cut", bag: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later failures restart from there.

    bag, if given, collects the folders, for drop_bag().
    """
    path = f"{shared_dir(df.sparkSession)}/patchloom/{name}-{uuid.uuid4().hex}"
    prepared(df).write.parquet(path)
    if bag is not None:
        bag.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_bag(spark: SparkSession, bag: list[str]) -> None:
    """Deletes the tables of a bag, once nothing reads them any more."""
    for folder in bag:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    bag.clear()


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a table that cut() made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/patchloom/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts of finished steps, which it does once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes(kind: T.DataType, x: Column) -> Column | int:
    """Bytes that a value takes beside its eight in a row: a number, or a column where values differ."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(x), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return 8 + sum((8 + _bytes(f.dataType, x.getField(f.name)) for f in kind.fields), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = _bytes(kind.elementType, F.lit(None))
        one = 8 + inner if isinstance(inner, int) else 8 * (2 + len(getattr(kind.elementType, "fields", [])))
        return F.greatest(F.size(x), F.lit(0)) * one + 16
    return 0


def measured(df: DataFrame) -> int:
    """Bytes that a table made by cut() takes as rows of a join's hash table: rows are counted, and so are the sizes of
    texts and arrays in them; a row has eight bytes for each column, and forty for itself and its place in the table."""
    wide = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0))
    n, extra = df.agg(F.count(F.lit(1)), F.sum(wide)).first()
    return n * (40 + 8 * len(df.columns)) + int(extra or 0)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table made by cut() is small, see measured()."""
    return measured(df) <= limit


def side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size allows it, else as it is: then Spark shuffles both sides."""
    return F.broadcast(df) if small_enough(df, limit) else df


def sized(df: DataFrame, n_bytes: float, per_core: int = 1, part: int = 8 << 20) -> DataFrame:
    """df in no more partitions than a bound on its bytes asks for, but some for each core: a table that is dealt over a
    cluster's partitions needs fewer tasks and files if it is small. A large one stays as it is dealt."""
    return df.coalesce(int(max(per_core * df.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // part))))


def compact(df: DataFrame, limit: int = BROADCAST_BYTES // 4) -> DataFrame:
    """A table made by cut(), read by one task if its counted size allows it: what follows then needs no exchange."""
    return df.coalesce(1) if small_enough(df, limit) else df


def identity(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """_k, the id with null last, and _t, a hash of the text. Rows equal in both are one document."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t")]


def held(df: DataFrame, *cols: str) -> DataFrame:
    """(_row, cols, _k, _t): all of df's columns as one, so that no name of theirs meets a name in use here; see identity()."""
    return prepared(df).select(F.struct("*").alias("_row"), *cols, *identity())


def dense_index(df: DataFrame, order: list[Column], rows_per_part: int = 200_000) -> tuple[DataFrame, int]:
    """df with _i, the row's place from 0 in the given order, and the row count.

    Rows are dealt by range, numbered within their range, and shifted by the number of rows in earlier ranges; only one
    count for each range comes to the driver. The order must be total, or equal rows take their places in any order.
    """
    from pyspark.sql import Window

    n = df.count()
    parts = max(1, min(20_000, -(-n // rows_per_part)))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dense")
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offset = 0, {}
    for p in sorted(counts):
        offset[p] = before
        before += counts[p]
    spark = df.sparkSession
    shifts = spark.createDataFrame([(int(p), int(v)) for p, v in offset.items()], "_part int, _before long")
    numbered = dealt.join(F.broadcast(shifts), "_part").withColumn(
        "_i", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    )
    return numbered.drop("_part", "_before"), n


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) drawn by the columns' values and the seed: the same in every run."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
