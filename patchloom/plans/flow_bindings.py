"""Flow and rank operators bound to the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.operators import flows as W
from patchloom.operators import graph as G
from patchloom.plans.bindings import bound, table
from patchloom.session import checkpointed

#: A user's events as the lines of a function; values flow to the next line of the same type, from every third event to
#: the next line, and from every eleventh two lines back, which makes loops.
LINES = """l AS (SELECT user_id AS u, event_type AS t, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
e AS (SELECT u, line AS a, lead(line) OVER (PARTITION BY u, t ORDER BY line) AS b FROM l UNION SELECT u, line, line + 1 FROM l WHERE i % 3 = 0 UNION SELECT u, line, line - 2 FROM l WHERE i % 11 = 0 AND line > 2),
x AS (SELECT e.* FROM e JOIN l ON l.u = e.u AND l.line = e.b)"""
HOPS = 6


def _flow_sql(source: str, window: str) -> str:
    return f"""WITH RECURSIVE {LINES},
f AS (SELECT u, line AS s, line AS n, 0 AS h FROM l WHERE {source} UNION SELECT f.u, f.s, x.b, f.h + 1 FROM f JOIN x ON x.u = f.u AND x.a = f.n WHERE f.h < {HOPS}),
d AS (SELECT u, s, n, min(h) AS h FROM f GROUP BY ALL),
w AS (SELECT d.u, d.s, d.n, d.h, min(p.n) AS p FROM d LEFT JOIN x ON x.u = d.u AND x.b = d.n LEFT JOIN d p ON p.u = d.u AND p.s = d.s AND p.n = x.a AND p.h = d.h - 1 GROUP BY ALL),
m AS (SELECT w.u, w.s, w.n AS k, w.h, w.p AS bk, [w.n] AS path FROM w JOIN l a ON a.u = w.u AND a.line = w.s JOIN l b ON b.u = w.u AND b.line = w.n WHERE w.h > 0 AND w.n <> w.s AND {window}),
r AS (SELECT * FROM m UNION ALL SELECT r.u, r.s, r.k, r.h, w.p, list_prepend(r.bk, r.path) FROM r JOIN w ON w.u = r.u AND w.s = r.s AND w.n = r.bk)
SELECT u AS user_id, s AS source, k AS sink, h AS hops, array_to_string(path, '>') AS path FROM r WHERE bk IS NULL"""


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (user_id, node, name, line, is_return) and edges (user_id, src, dst), see LINES."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = table(spark, sf, "events", "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", F.col("event_type").alias("name"), F.row_number().over(w).alias("line"))
    # numbered once: nodes are read as edges, sources and sinks
    n = checkpointed(n.select("user_id", "event_id", "name", "line", F.col("line").alias("node"), (F.col("name") == "purchase").alias("is_return")))
    chain = n.select("user_id", F.col("line").alias("src"), F.lead("line").over(Window.partitionBy("user_id", "name").orderBy("line")).alias("dst"))
    on = n.where("event_id % 3 = 0").select("user_id", F.col("line").alias("src"), (F.col("line") + 1).alias("dst"))
    back = n.where("event_id % 11 = 0 and line > 2").select("user_id", F.col("line").alias("src"), (F.col("line") - 2).alias("dst"))
    edges = chain.unionByName(on).unionByName(back).join(n.select("user_id", F.col("line").alias("dst")), ["user_id", "dst"], "left_semi")
    return n, edges


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("path", F.array_join("path", ">"))


@bound(_flow_sql("t = 'signup'", "b.t = 'purchase' AND b.line > a.line AND b.line < a.line + 12"))
def flow_to_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of up to six edges from signups to the same user's purchases, which stand for returns, within twelve lines."""
    n, e = _lines(spark, sf)
    asked = n.where("name = 'signup'").select("user_id", "name", F.col("line").alias("src_line"), (F.col("line") + 12).alias("dst_line"))
    return _shown(W.identifier_flows(n, e, asked, "user_id", hops=HOPS, prune=False))


@bound(_flow_sql("t IN ('error', 'view')", "b.t = a.t AND b.line > a.line AND b.line < a.line + 20"))
def flow_to_same_name(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of up to six edges from errors and views to the same user's events of the same type within twenty lines."""
    n, e = _lines(spark, sf)
    asked = n.where("name in ('error', 'view')").select("user_id", "name", F.col("line").alias("src_line"), (F.col("line") + 20).alias("dst_line"))
    return _shown(W.identifier_flows(n, e, asked, "user_id", to_returns=False, hops=HOPS, prune=False))


ROUNDS = 8
#: Each region's tree of nations and suppliers, with every supplier of an odd number leading back to its nation's region.
SEEDED = """WITH e AS (SELECT n_regionkey AS k, 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation
  UNION SELECT n_regionkey, 'n' || n_nationkey, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
  UNION SELECT n_regionkey, 's' || s_suppkey, 'r' || n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1),
b AS (SELECT * FROM e UNION SELECT k, b, a FROM e),
seed AS (SELECT DISTINCT n_regionkey AS k, n_nationkey AS g, 's' || s_suppkey AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 10 < 3),
j1 AS (SELECT * FROM seed UNION SELECT j.k, g, b.b FROM seed j JOIN b ON b.k = j.k AND b.a = n),
j2 AS (SELECT * FROM j1 UNION SELECT j.k, g, b.b FROM j1 j JOIN b ON b.k = j.k AND b.a = n),
v AS (SELECT * FROM j2 UNION SELECT j.k, g, b.b FROM j2 j JOIN b ON b.k = j.k AND b.a = n),
x AS (SELECT p.k, p.g, e.a, e.b FROM e JOIN v p ON p.k = e.k AND p.n = e.a JOIN v q ON q.k = p.k AND q.g = p.g AND q.n = e.b),
d AS (SELECT k, g, a, count(*) AS deg FROM x GROUP BY ALL),
z AS (SELECT v.k, v.g, v.n, coalesce(s.part, 0) AS part, deg FROM v LEFT JOIN (SELECT *, 1 / count(*) OVER (PARTITION BY k, g) AS part FROM seed) s USING (k, g, n) LEFT JOIN d ON d.k = v.k AND d.g = v.g AND d.a = v.n),
r0 AS (SELECT k, g, n, part AS rank FROM z)""" + "".join(
    f""", r{i + 1} AS (SELECT z.k, z.g, z.n, z.part * (0.15::double + 0.85::double * coalesce(o.lost, 0)) + 0.85::double * coalesce(t.got, 0) AS rank FROM z
  LEFT JOIN (SELECT k, g, sum(rank) AS lost FROM r{i} JOIN z USING (k, g, n) WHERE deg IS NULL GROUP BY ALL) o ON o.k = z.k AND o.g = z.g
  LEFT JOIN (SELECT x.k, x.g, x.b, sum(rank / deg) AS got FROM r{i} r JOIN z USING (k, g, n) JOIN x ON x.k = r.k AND x.g = r.g AND x.a = r.n GROUP BY ALL) t ON t.k = z.k AND t.g = z.g AND t.b = z.n)"""
    for i in range(ROUNDS)
) + f" SELECT k AS region, g AS nation, n AS node, round(rank, 9) AS rank FROM r{ROUNDS}"


@bound(SEEDED)
def rank_near_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks within three jumps of each nation's seeds, three of ten suppliers, in the graph of its region."""
    n = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda p, c: F.concat(F.lit(p), c)
    edge = lambda df, a, b: df.select(F.col("n_regionkey").alias("region"), a.alias("src"), b.alias("dst"))
    e = edge(n, name("r", "n_regionkey"), name("n", "n_nationkey")).unionByName(edge(s, name("n", "n_nationkey"), name("s", "s_suppkey"))).unionByName(edge(s.where("s_suppkey % 2 = 1"), name("s", "s_suppkey"), name("r", "n_regionkey")))
    seeds = s.where("s_suppkey % 10 < 3").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), name("s", "s_suppkey").alias("node"))
    return W.seeded_ranks(e, seeds, "region", of="nation", rounds=ROUNDS).withColumn("rank", F.round("rank", 9))


@bound("""SELECT v AS version, 'r' || n_regionkey || '>n' || n_nationkey || '>s' || s_suppkey AS path,
  'r' || n_regionkey || '>n' || n_nationkey || ':' || (n_nationkey + o) || ',n' || n_nationkey || '>s' || s_suppkey || ':' || (s_suppkey + o) AS hops
  FROM nation JOIN supplier ON s_nationkey = n_nationkey, (VALUES ('pre', 0), ('post', 100000)) t(v, o) WHERE v = 'pre' OR s_suppkey % 3 > 0""")
def graph_path_lines_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of two versions of a graph, with the lines of the edges of their own version."""
    n = table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    up = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").cast("long").alias("line"), F.lit(0).cast("long").alias("k"))
    down = s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.col("s_suppkey").cast("long").alias("line"), F.col("s_suppkey").cast("long").alias("k"))
    both = up.unionByName(down)
    e = both.withColumn("version", F.lit("pre")).unionByName(both.where("dst like 'n%' or k % 3 > 0").withColumns({"version": F.lit("post"), "line": F.col("line") + 100_000}))
    g = G.build_graph(e.withColumns({"src_line": F.col("line"), "tgt_line": F.col("line")}), "version")
    node = lambda c, p: e.select("version", F.col(c).alias("node")).where(F.col("node").startswith(p)).distinct()
    paths = G.simple_paths(e, node("src", "r"), node("dst", "s"), "version")
    hops = F.transform("edge_path", lambda x: F.concat(x["caller"], F.lit(">"), x["callee"], F.lit(":"), x["source_tgt_pairs"][0]["s"]))
    return G.paths_with_lines(paths, g, "version").select("version", F.array_join("node_path", ">").alias("path"), F.array_join(hops, ",").alias("hops"))
