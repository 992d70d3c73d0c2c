"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.llm import common as C

#: Fixed by the contract of the query.
WORD, CYCLE, SHARE, MOST = r"[^\x20\x09-\x0D]+", (5.0, 2.0, 1.0), 1.5, 2.0
#: Weights are told apart in steps of one in STEPS, from 1 / STEPS to HEAVIEST: so many classes a source at most.
STEPS, HEAVIEST = 16, 64
#: Cells of the two radix levels that find the cut within a source.
CELLS = 1 << 12


def word_count(text) -> F.Column:
    """Number of maximal runs of characters other than blank and the control characters 9 to 13; 0 for null.

    Runs of separators are counted after the ends are stripped, which is what counting words comes to.
    """
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """One row a source with its target: (source, source_size, target).

    sizes has (source, source_size), one row a source. Sources in code point order, null last, get the weights of
    `cycle` in turn and divide share * total. A target stops at most * source_size and the excess is shared again by
    weight until none is above: the fixed point is min(most * size, level * weight) for one level, found from running
    sums over the sources in order of size over weight. Sources of size 0 get 0; so does everything if the total is 0.
    The windows run over the table of sources, a row each, not over documents.
    """
    k = len(cycle)
    # binary order of UTF-8 is code point order
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    w = F.element_at(F.array(*[F.lit(x) for x in cycle]), (F.pmod(rank - 1, F.lit(k)) + 1).cast("int"))
    every, through = Window.partitionBy(), Window.orderBy("_ratio", F.col("source").isNull(), "source")
    capped = F.col("_cap")
    out = (
        sizes.withColumns({"_w": w, "_cap": F.col("source_size") * F.lit(most)})
        .withColumn("_ratio", capped / F.col("_w"))
        .withColumns({
            "_cap_before": F.coalesce(F.sum(capped).over(through.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_w_left": F.sum("_w").over(through.rowsBetween(0, Window.unboundedFollowing)),
            "_all": F.sum("source_size").over(every) * F.lit(share),
        })
        .withColumn("_level", (F.col("_all") - F.col("_cap_before")) / F.col("_w_left"))
        .withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every))
        .withColumn("target", F.when(F.col("_found").isNull(), capped).otherwise(F.least(capped, F.col("_found._level") * F.col("_w"))))
    )
    return out.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))


def size_weight(size) -> F.Column:
    """The weight that the query gives a document: one more than the binary logarithm of its words, as a whole number."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) + F.lit(1e-9)) + 1


def levels(classes: DataFrame, most: float = MOST) -> DataFrame:
    """(source, _w, _e): the expected copies of a document of each weight, e = min(most, level * weight).

    classes are (source, _w, words, target), a row for each source and weight. The level is the one at which the words
    expected of all classes come to the source's target: the heaviest classes reach `most` first, and with them taken
    out the level of the rest follows from two running sums. A source none of whose words has a weight takes none.
    """
    heavy = Window.partitionBy("source").orderBy(F.col("_w").desc())
    every = Window.partitionBy("source")
    level = F.try_divide(F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum(F.col("words") * F.col("_w")).over(heavy.rowsBetween(0, Window.unboundedFollowing)))
    out = classes.where("_w > 0").withColumn("_level", level)
    # the first class, from the heaviest on, that stays below the most
    out = out.withColumn("_found", F.max(F.when(F.col("_level") * F.col("_w") <= most, F.struct("_w", "_level"))).over(every))
    e = F.when(F.col("_found").isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.greatest(F.col("_found._level"), F.lit(0.0)) * F.col("_w")))
    return out.select("source", "_w", e.cast("double").alias("_e"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[float, ...] = CYCLE, seed: int = 20, weight: F.Column | str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies, taken: how often the mix takes each document.

    A document's expected number of copies e is a level of its source times its weight, `most` at most; the level is
    such that the words expected come to the source's target, see levels(). weight is a column over docs and size, by
    default 1; it is rounded to steps of 1 / STEPS, is HEAVIEST at most, and takes none where it is 0 or null.
    floor(e) copies are certain. The rest, pi = e - floor(e), is an inclusion probability: documents are ranked by
    odds(U) / odds(pi), U being a hash of id and source, and taken in that order until the words still open to the
    source's target are filled (Pareto order sampling; the sample's size in words is fixed up to one document, whose
    half decides).

    The cut in a source's order is found by two counts over radix cells of the rank and one look at the rows of a
    single cell, so no task gets a whole source. The per-source cuts are broadcast if their number allows.

    Nulls: a null text has size 0 and is taken 0 times for want of words; a null source is a source of its own, last
    in order; of null ids the text takes the place in the hash. Rows equal in id, source and text share one decision.
    Empty input gives no rows. Other columns pass through, whatever their names; columns of docs named like the results
    are replaced.
    """
    docs = C.prepared(docs).drop("size", "source_size", "target", "copies", "taken")
    sized = docs.withColumn("size", word_count(F.col("text")))
    weight = F.col(weight) if isinstance(weight, str) else weight
    w = F.lit(1.0) if weight is None else F.least(F.lit(float(HEAVIEST)), F.round(F.greatest(F.lit(0.0), F.coalesce(weight.cast("double"), F.lit(0.0))) * STEPS) / STEPS)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = sized.select(own.alias("_row"), "source", "size", w.alias("_w"), *C.identity())
    slim = C.cut(sized.select("_k", "_t", "source", "size", "_w"), "mix")
    classes = C.cut(slim.groupBy("source", "_w").agg(F.sum("size").alias("words")), "mixw")
    sizes = C.cut(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, cycle), "mixt")
    by_source = sizes.select(F.col("source").alias("_s"), "target")
    expected = levels(classes.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), most)
    expected = C.cut(expected.select(F.col("source").alias("_sw"), F.col("_w").alias("_ww"), "_e"), "mixe")

    def ranked(rows: DataFrame, by: DataFrame) -> DataFrame:
        """rows with the source's plan, certain copies and rank in (0, 1)."""
        by = C.side(by.withColumnRenamed("source", "_source"))
        of = C.side(expected)
        named = F.concat_ws("|", F.lit(str(seed)), F.when(F.col("_k") != C.NULL_ID, F.col("_k").cast("string")).otherwise(F.concat(F.lit("null "), F.col("_t"))), "source")
        u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        odds = F.col("_u") / (1 - F.col("_u"))
        pi = F.least(F.greatest(F.col("_pi"), F.lit(1e-12)), F.lit(1 - 1e-12))
        q = odds / (pi / (1 - pi))
        return (
            rows.join(by, rows["source"].eqNullSafe(by["_source"])).drop("_source")
            .join(of, F.col("source").eqNullSafe(F.col("_sw")) & (F.col("_w") == F.col("_ww")), "left").drop("_sw", "_ww")
            .withColumns({"_e": F.coalesce("_e", F.lit(0.0)), "_u": u})
            .withColumn("_sure", F.floor("_e").cast("int"))
            .withColumn("_pi", F.col("_e") - F.col("_sure"))
            .withColumn("_q", F.when(F.col("_pi") > 0, q / (1 + q)).otherwise(F.lit(1.0)))
            .withColumn("_c1", F.least(F.floor(F.col("_q") * CELLS), F.lit(CELLS - 1)).cast("int"))
            .withColumn("_c2", F.least(F.floor((F.col("_q") * CELLS - F.col("_c1")) * CELLS), F.lit(CELLS - 1)).cast("int"))
        )

    plan = sizes
    r = ranked(slim, plan)
    open_ = F.col("target") - F.col("_sure_words")

    def crossing(cells: DataFrame, cell: str, need: str) -> DataFrame:
        """For each source the first cell in which the words pass what is needed, and the words before it."""
        through = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        run = cells.withColumn("_run", F.sum("_words").over(through))
        hit = run.where(F.col("_run") > F.col(need)).groupBy("source").agg(F.min(F.struct(F.col(cell).alias("c"), (F.col("_run") - F.col("_words")).alias("before"), F.col(need).alias("need"))).alias("_x"))
        return hit.select("source", F.col("_x.c").alias(cell), (F.col("_x.need") - F.col("_x.before")).alias("_rest"))

    sums = r.groupBy("source", "_c1").agg(F.sum(F.when(F.col("_pi") > 0, F.col("size")).otherwise(F.lit(0))).alias("_words"), F.sum(F.col("size") * F.col("_sure")).alias("_sure_part"), F.first("target").alias("target"))
    whole = Window.partitionBy("source")
    sums = sums.withColumn("_sure_words", F.sum("_sure_part").over(whole)).withColumn("_need", open_)
    cut1 = C.cut(crossing(sums, "_c1", "_need"), "mix1")

    def within(rows: DataFrame, cuts: DataFrame, on: list[str]) -> DataFrame:
        cuts = C.side(cuts.select(*[F.col(c).alias(f"_x{c}") for c in on], "_rest"))
        same = rows["source"].eqNullSafe(cuts["_xsource"])
        for c in on[1:]:
            same = same & (rows[c] == cuts[f"_x{c}"])
        return rows.join(cuts, same).drop(*[f"_x{c}" for c in on]).where(F.col("_pi") > 0)

    cells2 = within(r, cut1, ["source", "_c1"]).groupBy("source", "_c1", "_c2").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_need"))
    cut2 = C.cut(crossing(cells2, "_c2", "_need").join(cut1.select(F.col("source").alias("_s"), "_c1"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix2")
    # rows of one cell in 16 million of each source: those that agree wholly count as one
    last = within(r, cut2, ["source", "_c1", "_c2"]).groupBy("source", "_q", "_k", "_t").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_need"))
    order = Window.partitionBy("source").orderBy("_q", "_k", "_t").rowsBetween(Window.unboundedPreceding, 0)
    # the document at the cut is in if at least half of it is still open
    run = last.withColumn("_run", F.sum("_words").over(order)).where(F.col("_run") - F.col("_words") / 2 <= F.col("_need"))
    ends = run.groupBy("source").agg(F.max(F.struct("_q", "_k", "_t")).alias("_end"))
    # a source with no cell in which the need is passed takes all; one with a cell but no end takes what lies before the cell
    cuts = cut2.withColumnRenamed("source", "_s").join(ends, F.col("_s").eqNullSafe(F.col("source")), "left").select(
        F.col("_s").alias("source"), F.col("_c1").alias("_x1"), F.col("_c2").alias("_x2"), F.col("_end")
    )
    first = cut1.select(F.col("source").alias("_s1"))
    plan = C.cut(
        plan.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        .join(first, F.col("source").eqNullSafe(F.col("_s1")), "left").drop("_s1"), "mixc")
    here = F.struct("_q", "_k", "_t")
    before = (F.col("_c1") < F.col("_x1")) | ((F.col("_c1") == F.col("_x1")) & (F.col("_c2") < F.col("_x2")))
    at = (F.col("_c1") == F.col("_x1")) & (F.col("_c2") == F.col("_x2")) & F.coalesce(here <= F.col("_end"), F.lit(False))
    taken_too = (F.col("_pi") > 0) & F.coalesce(before | at, F.lit(True))
    return (
        ranked(sized, plan)
        .withColumn("copies", F.when(F.col("size") > 0, F.col("_sure") + taken_too.cast("int")).otherwise(F.lit(0)))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .select("_row.*", "size", "source_size", "target", "copies", "taken")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() over all documents, weighted by size_weight(): longer ones are likelier, in any source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, weight=size_weight(F.col("size"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: each row as often as it is taken; a document without words, which no mix can take, goes."""
    held = docs.select(F.struct("*").alias("held"), "doc_id", "source", "text")
    out = mix(held, weight=size_weight(F.col("size"))).where("copies > 0")
    return out.select("held", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("held.*")


#: The same sample: targets and levels by their fixed points, ranks from the same hashes, and running sums over whole sources.
SQL = r"""
WITH d0 AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
d AS (SELECT *, (floor(log2(greatest(size, 1)::double) + 1e-9) + 1)::double AS dw FROM d0),
s AS (SELECT source, sum(size)::bigint AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, ([5, 2, 1][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3) + 1])::double AS w, 2.0::double * ss AS cap FROM s),
x AS (SELECT *, cap / w AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(ss) OVER ())::double * 1.5::double AS every FROM w),
l AS (SELECT *, (every - before) / rest AS level FROM x),
m AS (SELECT min(struct_pack(a := ratio, b := level)) FILTER (level <= ratio) AS f FROM l),
t AS (SELECT source AS src, ss, CASE WHEN f IS NULL THEN cap ELSE least(cap, f.b * w) END AS target FROM l, m),
k AS (SELECT source AS ks, dw AS kw, sum(size)::bigint AS words FROM d GROUP BY ALL),
kl AS (SELECT k.*, (target - 2.0::double * coalesce(sum(words) OVER (PARTITION BY ks ORDER BY kw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double)
  / nullif(sum(words * kw) OVER (PARTITION BY ks ORDER BY kw DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM k JOIN t ON src IS NOT DISTINCT FROM ks),
kf AS (SELECT *, max(struct_pack(a := kw, b := level)) FILTER (level * kw <= 2.0::double) OVER (PARTITION BY ks) AS f FROM kl),
ke AS (SELECT ks, kw, CASE WHEN f IS NULL THEN 2.0::double ELSE least(2.0::double, greatest(f.b, 0) * kw) END AS e FROM kf),
e AS (SELECT d.*, ss, target, ke.e,
  (('0x' || substr(md5(concat_ws('|', '20', doc_id::varchar, source)), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double AS u FROM d JOIN t ON src IS NOT DISTINCT FROM source JOIN ke ON ks IS NOT DISTINCT FROM source AND kw = dw),
p AS (SELECT *, floor(e) AS sure, e - floor(e) AS pi, least(greatest(e - floor(e), 1e-12), 1 - 1e-12) AS c FROM e),
q AS (SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (c / (1 - c)) END AS q FROM p),
r AS (SELECT *, target - sum(size * sure) OVER (PARTITION BY source) AS need,
  sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM q),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE sure + (pi > 0 AND run - size / 2 <= need)::int END::int AS copies FROM r)
SELECT doc_id, size, ss AS source_size, target, (copies * size)::bigint AS taken, source, copies FROM n
"""
