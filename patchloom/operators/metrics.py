"""Evaluation aggregates: plain formulas over long tables, with overlapping families as exploded membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 as columns; null where a denominator is 0."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]


def with_all(rows: DataFrame, family: str, all_name: str = "all") -> DataFrame:
    """rows and each of them once more under the family `all`. An item in several families is first reduced by item."""
    return rows.unionByName(rows.withColumn(family, F.lit(all_name)))


def category_counts(items: DataFrame, labels: str, sep: str = ",", item: str | None = None) -> DataFrame:
    """(category, n, items?): items counted under each of their comma-separated labels; blanks around labels don't count."""
    x = items.select(*([item] if item else []), F.explode(F.array_distinct(F.transform(F.split(labels, sep), lambda x: F.trim(x)))).alias("category")).where("category <> ''")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.array_sort(F.collect_list(item)).alias("items")] if item else [])
    return x.groupBy("category").agg(*aggs)


def roll_up(counts: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(family, category, n): category counts under fixed families; a category may be in several, others are left out."""
    pairs = [(f, c) for f, cs in families.items() for c in cs]
    table = F.broadcast(counts.sparkSession.createDataFrame(pairs, "family string, category string"))
    return counts.join(table, "category").select("family", "category", "n")


def set_counts(items: DataFrame, pred: str, true: str, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, exact): set comparison of two array columns of each row. Null arrays count as empty."""
    e = F.array().cast("array<string>")
    p, t = F.array_distinct(F.coalesce(F.col(pred).cast("array<string>"), e)), F.array_distinct(F.coalesce(F.col(true).cast("array<string>"), e))
    return items.select(*keys, F.size(F.array_intersect(p, t)).alias("tp"), F.size(F.array_except(p, t)).alias("fp"), F.size(F.array_except(t, p)).alias("fn"), (F.array_sort(p) == F.array_sort(t)).alias("exact"))


def set_prf(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, tp, fp, fn, n_exact, precision, recall, f1): totals of set_counts() and micro-averaged metrics."""
    s = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(F.col("exact").cast("int")).alias("n_exact"))
    return s.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def relative_change(new: Column, old: Column, absolute: bool = False) -> Column:
    """(new - old) / old; null where old is 0 or null."""
    x = F.try_divide(new - old, old)
    return F.abs(x) if absolute else x


def label_prf(rows: DataFrame, family: str, tool: str, label: str) -> DataFrame:
    """(family, tool, tp, fp, precision, recall, f1): rows labelled TP or FP; recall is over all TP rows of the family,
    whichever tool found them."""
    s = rows.groupBy(family, tool).agg(F.count(F.when(F.col(label) == "TP", 1)).alias("tp"), F.count(F.when(F.col(label) == "FP", 1)).alias("fp"))
    every = F.sum("tp").over(Window.partitionBy(family))
    s = s.withColumn("_all", every)
    return s.select(family, tool, "tp", "fp", *prf(F.col("tp"), F.col("fp"), F.col("_all") - F.col("tp")))


def rates(rows: DataFrame, family: str, measures: list[str]) -> DataFrame:
    """(family, measure, n, n_ok, rate): share of rows with a value above 0, for each measure column; null is no value."""
    long_ = rows.unpivot([family], measures, "measure", "value")
    s = long_.groupBy(family, "measure").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 0, 1)).alias("n_ok"))
    return s.withColumn("rate", F.try_divide("n_ok", "n"))


def pivot_rates(rate_rows: DataFrame, family: str, measures: list[str]) -> DataFrame:
    """(family, one column a measure): rates() side by side."""
    return rate_rows.groupBy(family).pivot("measure", measures).agg(F.first("rate"))


def missing_to_null(value: Column) -> Column:
    """NaN and negative sentinels as null."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (v >= 0), v)


def time_to_event(rows: DataFrame, family: str, a: str, b: str) -> DataFrame:
    """(family, n, n_both, mean_a, mean_b, rate_a, rate_b, time_change, rate_change): means over rows where both arms
    have a time, rates over all rows; the change of times is absolute."""
    x, y = missing_to_null(F.col(a)), missing_to_null(F.col(b))
    both = x.isNotNull() & y.isNotNull()
    s = rows.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(both, 1)).alias("n_both"), F.avg(F.when(both, x)).alias("mean_a"), F.avg(F.when(both, y)).alias("mean_b"),
        (F.count(x) / F.count(F.lit(1))).alias("rate_a"), (F.count(y) / F.count(F.lit(1))).alias("rate_b"))
    return s.select("*", relative_change(F.col("mean_b"), F.col("mean_a"), True).alias("time_change"), relative_change(F.col("rate_b"), F.col("rate_a")).alias("rate_change"))


def hit_all(name: Column, true: Column) -> Column:
    """Whether a name is part of every true item; not, if there is none."""
    return (F.size(true) > 0) & F.forall(true, lambda t: F.contains(t, name))


def hit_any(name: Column, false: Column) -> Column:
    """Whether a name is part of any item."""
    return F.exists(false, lambda t: F.contains(t, name))


def covered(pred: Column, true: Column) -> Column:
    """Whether each true path has a prediction that contains its last part; not, if there is none."""
    return (F.size(true) > 0) & F.forall(true, lambda t: F.exists(pred, lambda p: F.contains(p, F.element_at(F.split(t, "/"), -1))))


def ratio_by_category(rows: DataFrame, category: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(category, n, one column a ratio): mean over a category's rows of numerator over denominator; rows with
    denominator 0 or null are left out of that mean, and the divisor is the number of rows that count."""
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double"))).alias(k) for k, (n, d) in pairs.items()])


def ledger(submitted: DataFrame, done: DataFrame, failed: DataFrame, key: str, missing: str = "TIMEOUT") -> DataFrame:
    """(key, summary): failed items with their summary, and submitted ones neither done nor failed as `missing`."""
    gone = submitted.select(key).distinct().join(done, key, "left_anti").join(failed, key, "left_anti")
    return failed.select(key, "summary").unionByName(gone.withColumn("summary", F.lit(missing)))


def pending(items: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Items not completed yet."""
    return items.join(completed, key, "left_anti")


def argmax_first(rows: DataFrame, value: str, at: str, *keys: str) -> DataFrame:
    """(keys, at, value): the largest value and the smallest place that has it, for each key."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(at)).alias("_m"))).alias("_b")) if keys else rows.agg(F.max(F.struct(F.col(value), (-F.col(at)).alias("_m"))).alias("_b"))
    return best.select(*keys, (-F.col("_b._m")).alias(at), F.col(f"_b.{value}").alias(value))


def top_n_sweep(rows: DataFrame, score: str, tie: str, most: int, *keys: str) -> DataFrame:
    """(keys, top_n, rank, tie, score): each key's best rows for every cut 1 .. most: a row of rank r is in cuts r and up."""
    r = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= most)
    return r.select(*keys, F.explode(F.sequence(F.col("rank"), F.lit(most))).alias("top_n"), "rank", tie, score)


def latest(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def rank_by_overlap(rows: DataFrame, query: str, text: str, tie: str, *keys: str) -> DataFrame:
    """rows with score and rank: a deterministic stand-in for a model that ranks texts for a description.

    The score is the sum over words that both share of log(1 + rows / rows with the word), so rare words count more; it is
    rounded to nine places, lest the order of summation decide ties. Ranks are within a key, and one is needed.
    """
    if not keys:
        raise ValueError("ranks need a key; one rank over all rows would be one task's work")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))
    x = rows.withColumn("_id", F.struct(*keys, tie))
    w = x.select("_id", F.explode(words(text)).alias("w"))
    df = w.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    q = x.select("_id", F.explode(words(query)).alias("w"))
    n = rows.agg(F.count(F.lit(1)).cast("double")).scalar()
    s = w.join(q, ["_id", "w"]).join(df, "w").groupBy("_id").agg(F.sum(F.log(1 + n / F.col("df"))).alias("score"))
    out = x.join(s, "_id", "left").drop("_id").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), tie)))
