"""Transaction log reassembly: which changes of a log survive, and the state of the store after each epoch of commits.

A log is a table of records (pos, source, op, key, value, ...). Each source runs successive transactions; op is one of

* "set" and "delete": key takes value, or goes;
* "savepoint", and "rollback", which undoes the changes of its transaction that are left since the latest savepoint left
  (without one: since the start), and takes that savepoint away;
* "commit", which applies what is left of its transaction in log order, and "abort", which undoes it. So does the log's end.

DataFrame functions only. The log is dealt by ranges of position, and every step works within a range first: what has to
pass from one range to the next is a row for each range and source, at most SEGMENTS for each source. So no source, key or
transaction, however large, meets in one task, nothing goes to the driver but counts, and joins are by key, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C

#: Records in a range, while there are fewer than SEGMENTS ranges.
SEGMENT, SEGMENTS = 8192, 4096
#: Commits in an epoch; epochs in a block, while there are fewer than BLOCKS blocks.
EPOCH, BLOCK, BLOCKS = 64, 16, 1024
#: Fixed by the contract of the query: keys of the store.
KEYS = 30_000

_UP = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)
_AFTER = (1, Window.unboundedFollowing)
_FROM = (0, Window.unboundedFollowing)


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join by key that Spark never turns into a broadcast: what is broadcast here would grow with the log."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def _prefix(parts: DataFrame, by: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """parts with the sums of columns over earlier parts: a row a part, so `by` bounds what one task gets."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(*_BEFORE)
    return parts.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0)) for name, c in sums.items()})


def ordered(log: DataFrame, segment: int = SEGMENT, epoch: int = EPOCH, bag: list[str] | None = None) -> tuple[DataFrame, int]:
    """The log in order, written: (seg, i, at, s, op, key, value, epoch), and the number of its commits.

    i counts records in order of pos; records of one position are ordered by source, op, key and value, and those that
    agree in all of these are told apart by nothing that matters. seg is the range that holds i, s the source as a text
    that is never null, at is pos, and epoch numbers the epoch of a commit from 1, null for other records.
    Records without a position are no part of a log and are left out.
    """
    s = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = log.where(F.col("pos").isNotNull()).select(F.col("pos").cast("long").alias("at"), s.alias("s"), "op", "key", "value")
    rows = C.cut(rows, "log", bag)
    order = ["at", "s", "op", "key", "value"]
    n = rows.count()
    parts = max(1, min(SEGMENTS, -(-n // segment)))
    dealt = C.cut(rows.repartitionByRange(parts, *order).withColumn("seg", F.spark_partition_id()), "logr", bag)
    commit = (F.col("op") == "commit").cast("long")
    counts = dealt.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum(commit).alias("c"))
    counts = _prefix(counts, [], "seg", {"_i": "n", "_c": "c"})
    w = Window.partitionBy("seg").orderBy(*order)
    own = dealt.withColumns({"i": F.row_number().over(w), "c": F.sum(commit).over(w.rowsBetween(*_UP))})
    own = _joined(own, counts.select("seg", "_i", "_c"), ["seg"])
    number = F.when(F.col("op") == "commit", F.floor((F.col("c") + F.col("_c") - 1) / epoch) + 1)
    out = C.cut(own.select("seg", (F.col("i") + F.col("_i")).alias("i"), "at", "s", "op", "key", "value", number.alias("epoch")), "logi", bag)
    return out, int(dealt.agg(F.sum(commit)).first()[0] or 0)


def fates(log: DataFrame, bag: list[str] | None = None) -> DataFrame:
    """What becomes of each change of a log in order, see ordered(): (i, at, s, op, key, value, kind, by, epoch).

    kind is "commit", "abort" or "rollback"; by is the position of the record that decided, null for the log's end; epoch
    is that of the commit. A level counts savepoints less rollbacks within a source, without regard to what they find. It
    moves by steps of one, so a change is undone by the first later rollback of its transaction that takes the level
    below the change's own, and that is the next one that arrives at exactly one less: a look ahead among records of one
    source, transaction and level, in place of a stack. Transactions and levels count from the start of a range; those
    that go on beyond it find their end by a second look over ranges.
    """
    end = F.col("op").isin("commit", "abort")
    step = F.when(F.col("op") == "savepoint", 1).when(F.col("op") == "rollback", -1).otherwise(0).cast("long")
    own = Window.partitionBy("s", "seg").orderBy("i")
    ender = F.when(end, F.struct("i", "at", "op", "epoch"))
    rows = log.withColumns({
        "txn": F.coalesce(F.sum(end.cast("long")).over(own.rowsBetween(*_BEFORE)), F.lit(0)),
        "level": F.sum(step).over(own.rowsBetween(*_UP)),
        "ender": F.first(ender, ignorenulls=True).over(own.rowsBetween(*_FROM)),
    })
    # a rollback answers changes one level above the one it arrives at
    meet = F.col("level") + (F.col("op") == "rollback").cast("long")
    back = F.when(F.col("op") == "rollback", F.struct("i", "at"))
    ahead = Window.partitionBy("s", "seg", "txn", "meet").orderBy("i").rowsBetween(*_AFTER)
    rows = rows.withColumn("meet", meet).withColumn("back", F.first(back, ignorenulls=True).over(ahead))
    rows = C.cut(rows.where(F.col("op").isin("set", "delete", "rollback") | end), "logf", bag)

    # a row for each source and range: where its counts begin, and the first end of a transaction after it
    parts = log.groupBy("s", "seg").agg(F.sum(end.cast("long")).alias("n"), F.sum(step).alias("up"), F.min(ender).alias("first"))
    by_source = Window.partitionBy("s").orderBy("seg")
    parts = _prefix(parts, ["s"], "seg", {"txn0": "n", "level0": "up"}).withColumn("later", F.first("first", ignorenulls=True).over(by_source.rowsBetween(*_AFTER)))
    parts = C.cut(parts.select("s", "seg", "txn0", "level0", "later"), "logp", bag)

    changes = rows.where(F.col("op").isin("set", "delete"))
    settled = changes.where(F.col("back").isNotNull() | F.col("ender").isNotNull()).select(*_CHANGE, "back", "ender")
    # the others' transactions go on: the first rollback to each level in later ranges of the same transaction decides
    placed = lambda df: _joined(df, parts, ["s", "seg"]).withColumns({"txn": F.col("txn") + F.col("txn0"), "meet": F.col("meet") + F.col("level0")})
    open_ = placed(changes.where(F.col("back").isNull() & F.col("ender").isNull()))
    open_ = C.cut(open_.select(*_CHANGE, "seg", "txn", "meet", F.col("later").alias("ender")), "logo", bag)
    heads = placed(rows.where((F.col("op") == "rollback") & (F.col("txn") == 0)).groupBy("s", "seg", "txn", "meet").agg(F.min(F.struct("i", "at")).alias("head")))
    keys = ["s", "txn", "meet", "seg"]
    asked = open_.select(*keys).distinct().withColumn("head", F.lit(None).cast("struct<i:bigint,at:bigint>"))
    both = asked.withColumn("asks", F.lit(1)).unionByName(heads.select(*keys, "head").withColumn("asks", F.lit(0))).groupBy(*keys).agg(F.max("asks").alias("asks"), F.max("head").alias("head"))
    found = both.withColumn("back", F.first("head", ignorenulls=True).over(Window.partitionBy("s", "txn", "meet").orderBy("seg").rowsBetween(*_AFTER))).where("asks = 1")
    later = _joined(open_, found.select(*keys, "back"), keys).select(*_CHANGE, "back", "ender")

    undone, committed = F.col("back").isNotNull(), F.coalesce(F.col("ender.op") == "commit", F.lit(False))
    return settled.unionByName(later).select(
        *_CHANGE,
        F.when(undone, F.lit("rollback")).when(committed, F.lit("commit")).otherwise(F.lit("abort")).alias("kind"),
        F.when(undone, F.col("back.at")).otherwise(F.col("ender.at")).alias("by"),
        F.when(~undone & committed, F.col("ender.epoch")).alias("epoch"),
        F.when(~undone & committed, F.col("ender.i")).alias("commit_i"),
    )


_CHANGE = ["i", "at", "s", "op", "key", "value"]


def last_written(survivors: DataFrame, *by: str) -> DataFrame:
    """(by, key, last): of each group's surviving changes to a key the one applied last, as (commit_i, i, gone, value).

    Commits apply in log order, and the changes of one in theirs. The maximum is taken before any shuffle, so a key that
    has a third of all changes is a row a task.
    """
    last = F.struct("commit_i", "i", (F.col("op") == "delete").alias("gone"), "value")
    return survivors.groupBy(*by, "key").agg(F.max(last).alias("last"))


def replayed(survivors: DataFrame, n_epochs: int, block: int = BLOCK, bag: list[str] | None = None) -> DataFrame:
    """(epoch, n, value): after each epoch from 1 to n_epochs the number of stored keys and the sum of their values.

    Epochs are dealt into blocks. Each block's changes come to a map from keys to what was written last; prefixes of these
    maps over blocks, taken for all keys at once, are checkpoints: what each key that a block writes held when the block
    began, and the store's totals at that time. From these all blocks are replayed side by side, epoch by epoch.
    """
    spark = survivors.sparkSession
    size = max(block, -(-n_epochs // BLOCKS))
    of = F.floor((F.col("epoch") - 1) / size).cast("int")
    writes = C.cut(last_written(survivors.withColumn("block", of), "block", "epoch"), "logw", bag)
    maps = writes.groupBy("block", "key").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(*_BEFORE)
    # of maps that are combined, the later one's entry holds: over one key's maps, that of the block before
    checkpoint = C.cut(maps.withColumn("start", F.last("last").over(earlier)).select("block", "key", "start", F.col("last").alias("end")), "logc", bag)

    held = lambda x: F.when(x.isNotNull() & ~x.getField("gone"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    worth = lambda x: F.when(x.isNotNull() & ~x.getField("gone"), F.coalesce(x.getField("value").cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    gain = lambda a, b: {"dn": held(b) - held(a), "dv": worth(b) - worth(a)}
    begun = checkpoint.withColumns(gain(F.col("start"), F.col("end"))).groupBy("block").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    # every block and epoch has a row, even if it writes nothing
    epochs = spark.range(1, n_epochs + 1).select(F.col("id").alias("epoch")).withColumns({"block": of, "dn": F.lit(0).cast("long"), "dv": F.lit(0).cast("long")})
    totals = begun.unionByName(epochs.select("block", "dn", "dv").distinct()).groupBy("block").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    totals = _prefix(totals, [], "block", {"n0": "dn", "v0": "dv"}).select("block", "n0", "v0")

    before = F.lag("last").over(Window.partitionBy("block", "key").orderBy("epoch"))
    # a null key is a key
    begins = checkpoint.select(F.col("block").alias("_b"), F.col("key").alias("_k"), "start").hint("merge")
    steps = writes.hint("merge").join(begins, (F.col("block") == F.col("_b")) & F.col("key").eqNullSafe(F.col("_k")), "left")
    steps = steps.withColumn("before", F.coalesce(before, F.col("start"))).withColumns(gain(F.col("before"), F.col("last")))
    steps = steps.select("block", "epoch", "dn", "dv").unionByName(epochs.select("block", "epoch", "dn", "dv")).groupBy("block", "epoch").agg(F.sum("dn").alias("dn"), F.sum("dv").alias("dv"))
    run = Window.partitionBy("block").orderBy("epoch").rowsBetween(*_UP)
    out = _joined(steps.withColumns({"n": F.sum("dn").over(run), "v": F.sum("dv").over(run)}), totals, ["block"])
    return out.select("epoch", (F.col("n") + F.col("n0")).alias("n"), (F.col("v") + F.col("v0")).alias("value"))


def store(survivors: DataFrame, epoch: int | None = None) -> DataFrame:
    """(key, value): the store after an epoch, by default after the last. Values may be of any type that has an order."""
    upto = survivors if epoch is None else survivors.where(F.col("epoch") <= epoch)
    return last_written(upto).where(~F.col("last.gone")).select("key", F.col("last.value").alias("value"))


def reassemble(log: DataFrame, segment: int = SEGMENT, epoch: int = EPOCH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(fates, states) of a log of records (pos, source, op, key, value): see fates() and replayed().

    value is what a key weighs in the sum of the states, a long. Null sources are one source; a null key is a key; a null
    value of a set weighs 0. Unknown and null operations change nothing. Records without a position are left out; of
    records with one position, see ordered(). Columns other than these five are left out, whatever their names. An empty
    log has neither fates nor states.
    """
    C.prepared(log)
    bag: list[str] = []
    rows, n = ordered(log, segment, epoch, bag)
    out = C.cut(fates(rows, bag), "logx")
    C.drop_bag(log.sparkSession, bag)
    return out, replayed(out.where("kind = 'commit'"), -(-n // epoch), block)


def of_documents(docs: DataFrame, labels: DataFrame, keys: int = KEYS) -> DataFrame:
    """Documents as records of a log, as the contract of the query has it: op and key by a hash of doc_id; a change's value
    is the CRC-32 of its key, a colon and its text. Labels of one document count once; those of other documents not at all."""
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("_toxic", F.lit(True))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    key = F.floor(h / 100).cast("long") % keys
    slim = docs.select("doc_id", "source", h.alias("_h"), F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("text")).cast("binary")).alias("_v"))
    kind = F.col("_h") % 17
    gone = F.col("_v").isNull() | F.coalesce("_toxic", F.lit(False))
    op = F.when(kind <= 1, "commit").when(kind == 2, "abort").when(kind <= 4, "savepoint").when(kind <= 6, "rollback").when(gone, "delete").otherwise("set")
    change = kind > 6
    return _joined(slim, toxic, ["doc_id"]).select(
        F.col("doc_id").alias("pos"), "source", op.alias("op"),
        F.when(change, F.floor(F.col("_h") / 100).cast("long") % keys).alias("key"), F.when(change & ~gone, F.col("_v")).alias("value"),
    )


def op11_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reassemble() of all documents as a log: undone changes and states as (kind, id, n, value)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found, states = reassemble(of_documents(C.prepared(docs), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    undone = found.where("kind <> 'commit'").select("kind", F.col("at").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    return undone.unionByName(states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), "n", "value"))


#: The same with windows over whole sources and keys: the level a rollback arrives at finds the changes it undoes.
SQL = r"""
WITH c AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT doc_id, coalesce('=' || source, '') AS s, text, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda y: ('0x' || y)::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) AS h FROM documents, c WHERE doc_id IS NOT NULL),
o AS (SELECT *, h % 17 AS k, h // 100 % 30000 AS key FROM d),
l AS (SELECT *, k <= 2 AS ends, text IS NULL OR toxic AS gone,
  coalesce(sum((k <= 2)::int) OVER (PARTITION BY s ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn,
  sum(CASE WHEN k IN (3, 4) THEN 1 WHEN k IN (5, 6) THEN -1 ELSE 0 END) OVER (PARTITION BY s ORDER BY doc_id ROWS UNBOUNDED PRECEDING) + (k IN (5, 6))::int AS level,
  sum((k <= 1)::int) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS nth FROM o),
f AS (SELECT *, max(CASE WHEN ends THEN doc_id END) OVER t AS ender, max(CASE WHEN k <= 1 THEN (nth - 1) // 64 + 1 END) OVER t AS epoch,
  min(CASE WHEN k IN (5, 6) THEN doc_id END) OVER (PARTITION BY s, txn, level ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back
  FROM l WINDOW t AS (PARTITION BY s, txn)),
u AS (SELECT * FROM f WHERE k > 6),
v AS (SELECT epoch, key, arg_max(struct_pack(gone := gone, doc_id := doc_id), [ender, doc_id]) AS w FROM u WHERE back IS NULL AND epoch IS NOT NULL GROUP BY epoch, key),
x AS (SELECT epoch, key, w.gone AS gone, CASE WHEN NOT w.gone THEN
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(key || ':' || text)), '..'), lambda y: ('0x' || y)::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) ELSE 0 END AS crc
  FROM v JOIN documents ON documents.doc_id = w.doc_id, c),
y AS (SELECT epoch, (NOT gone)::int - coalesce((NOT lag(gone) OVER z)::int, 0) AS dn, crc - coalesce(lag(crc) OVER z, 0) AS dv FROM x WINDOW z AS (PARTITION BY key ORDER BY epoch)),
e AS (SELECT epoch, 0 AS dn, 0 AS dv FROM (SELECT unnest(range(1, (SELECT (max(nth) + 63) // 64 FROM l)::bigint + 1)) AS epoch) UNION ALL SELECT * FROM y),
g AS (SELECT epoch, sum(dn) AS dn, sum(dv) AS dv FROM e GROUP BY epoch)
SELECT 'state' AS kind, epoch::bigint AS id, (sum(dn) OVER (ORDER BY epoch))::bigint AS n, (sum(dv) OVER (ORDER BY epoch))::bigint AS value FROM g
UNION ALL SELECT 'rollback', doc_id, back, key FROM u WHERE back IS NOT NULL
UNION ALL SELECT 'abort', doc_id, ender, key FROM u WHERE back IS NULL AND epoch IS NULL
"""
