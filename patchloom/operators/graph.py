"""Graph algebra on edge tables (version, src, dst, src_line, tgt_line) and node tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.session import checkpointed


def build_graph(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst, pairs): parallel edges as one, with their sorted (src_line, tgt_line) pairs."""
    pair = F.struct(F.col("src_line").alias("s"), F.col("tgt_line").alias("t"))
    return edges.groupBy(*keys, "src", "dst").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))


def ends(points: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, is_source, is_sink): nodes without incoming, and without outgoing edges. Others are left out.

    Nodes are the given points and all ends of edges. A node without any edge is both.
    """
    into = edges.select(*keys, F.col("dst").alias("node")).distinct().withColumn("_in", F.lit(True))
    out = edges.select(*keys, F.col("src").alias("node")).distinct().withColumn("_out", F.lit(True))
    every = points.select(*keys, "node").unionByName(into.select(*keys, "node")).unionByName(out.select(*keys, "node")).distinct()
    both = every.join(into, [*keys, "node"], "left").join(out, [*keys, "node"], "left")
    return both.select(*keys, "node", F.col("_in").isNull().alias("is_source"), F.col("_out").isNull().alias("is_sink")).where("is_source or is_sink")


def reach(edges: DataFrame, seeds: DataFrame, *keys: str, directed: bool = True, limit: int = 1000, within: int | None = None) -> DataFrame:
    """(keys, node): all nodes that can be reached from the seeds (keys, node), these included; by `within` edges, if given.

    A frontier loop: each round joins the new nodes with the edges and takes out what earlier rounds found, so a cycle
    ends it. A round is checkpointed by itself; earlier ones are not written again. More than `limit` rounds raise an
    error.
    """
    e = edges.select(*keys, "src", "dst")
    if not directed:
        e = e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = checkpointed(e.distinct())
    seen = new = checkpointed(seeds.select(*keys, "node").distinct())
    for i in range(limit):
        if i == within:
            return seen
        step = new.withColumnRenamed("node", "src").join(e, [*keys, "src"]).select(*keys, F.col("dst").alias("node")).distinct()
        new = checkpointed(step.join(seen, [*keys, "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RuntimeError(f"more than {limit} rounds")


def simple_paths(edges: DataFrame, starts: DataFrame, stops: DataFrame, *keys: str, through: str | None = None, limit: int | None = None, prune: bool = True) -> DataFrame:
    """(keys, node_path): all paths from a start to the first stop met, without a node twice, as arrays of nodes.

    edges are (keys, src, dst), starts and stops (keys, node); every key is a graph of its own. A start that is a stop is
    a path of one node. With `through`, only paths that hold this node. Edges that can't lie on such a path are dropped
    first: both ends must be reachable from the starts and reach the stops, and with `through` lie before or after it
    (sources and sinks stay those of the whole graph). Paths grow by a recursive query; as no node stands twice, the
    number of edges that are left bounds their length (or `limit`, if given: longer paths raise an error). The number
    of simple paths itself is the only other bound.
    """
    spark = edges.sparkSession
    e = edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct()
    if prune:
        back = e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        if through is None:
            keep = reach(e, starts, *keys).join(reach(back, stops, *keys), [*keys, "node"], "left_semi")
        else:
            mid = starts.select(*keys, "node").unionByName(stops.select(*keys, "node")).select(*keys, F.lit(through).alias("node")).distinct()
            keep = reach(e, mid, *keys).unionByName(reach(back, mid, *keys)).distinct()
        e = e.join(keep.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi")
    e = checkpointed(e)
    if limit is None:
        limit = e.count() + 1
    tag = uuid.uuid4().hex
    names = {n: f"pl_{n}_{tag}" for n in ("e", "a", "z")}
    e.createOrReplaceTempView(names["e"])
    starts.select(*keys, "node").distinct().createOrReplaceTempView(names["a"])
    stops.select(*keys, "node").distinct().withColumn("stop", F.lit(True)).createOrReplaceTempView(names["z"])
    own = lambda t: "".join(f"{t}.`{k}`, " for k in keys)
    same = lambda x, y: "".join(f" AND {x}.`{k}` = {y}.`{k}`" for k in keys)
    out = spark.sql(f"""
        WITH RECURSIVE p({"".join(f"`{k}`, " for k in keys)}node, path, done) MAX RECURSION LEVEL {limit} AS (
          SELECT {own("a")}a.node, array(a.node), coalesce(z.stop, false) FROM {names["a"]} a LEFT JOIN {names["z"]} z ON z.node = a.node{same("z", "a")}
          UNION ALL
          SELECT {own("p")}e.dst, array_append(p.path, e.dst), coalesce(z.stop, false)
          FROM p JOIN {names["e"]} e ON e.src = p.node{same("e", "p")} LEFT JOIN {names["z"]} z ON z.node = e.dst{same("z", "e")}
          WHERE NOT p.done AND NOT array_contains(p.path, e.dst))
        SELECT {own("p")}path AS node_path FROM p WHERE done""")
    for name in names.values():  # the plan holds what they stood for
        spark.catalog.dropTempView(name)
    return out if through is None else out.where(F.array_contains("node_path", through))


def trigger_paths(points: DataFrame, edges: DataFrame, modified: DataFrame, wanted: DataFrame, *keys: str, version: str = "version", of: str = "pre") -> DataFrame:
    """(keys, version, node_path): for each version all simple paths from its modified nodes to the trigger, once each.

    points are (keys, version, node) and may have a column pos for their order, edges (keys, version, src, dst), modified
    (keys, version, node), wanted (keys, name). The trigger is the first point of the version `of` that ends in /name and
    stands for all versions. Keys whose trigger is not found have no paths.
    """
    first = points.where(F.col(version) == of)
    trigger = resolve_suffix(first, wanted, *keys).select(*keys, "node").distinct()
    graph = lambda df: df.withColumn("_g", F.struct(*keys) if keys else F.lit(0))
    stops = graph(edges.select(*keys, version).distinct()).join(graph(trigger).select("_g", "node"), "_g")
    return simple_paths(edges, modified, stops.select(*keys, version, "node"), *keys, version).distinct()


def paths_with_lines(paths: DataFrame, graph: DataFrame, *keys: str) -> DataFrame:
    """(keys, node_path, edge_path): each path with its edges as (caller, callee, pairs), from build_graph()'s rows.

    A path takes the edges of its own keys, such as its version.
    """
    e = checkpointed(paths.distinct().withColumn("_p", F.monotonically_increasing_id()))
    hops = F.expr("transform(sequence(1, size(node_path) - 1), i -> struct(node_path[i - 1] AS caller, node_path[i] AS callee))")
    steps = e.where(F.size("node_path") > 1).select(*keys, "_p", F.posexplode(hops).alias("pos", "x"))
    full = steps.select(*keys, "_p", "pos", F.col("x.caller").alias("src"), F.col("x.callee").alias("dst")).join(graph.select(*keys, "src", "dst", "pairs"), [*keys, "src", "dst"])
    full = full.groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("src").alias("caller"), F.col("dst").alias("callee"), "pairs"))), lambda x: F.struct(x["caller"].alias("caller"), x["callee"].alias("callee"), x["pairs"].alias("source_tgt_pairs"))).alias("edge_path"))
    return e.join(full, "_p", "left").drop("_p")


def resolve_suffix(points: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """(keys, name, node): for each wanted name the first point that ends in /name; names without one are left out.

    First is least by a column pos of points, if there is one, then by name. A point meets a name by one of its ends
    behind a slash, so this is an equi join on a few ends a point.
    """
    order = F.struct("pos", "node") if "pos" in points.columns else F.struct("node")
    slashes = F.filter(F.sequence(F.lit(1), F.length("node")), lambda i: F.substring(F.col("node"), i, F.lit(1)) == "/")
    tails = F.transform(slashes, lambda i: F.substring(F.col("node"), i + 1, F.length("node")))
    p = points.where(F.length("node") > 0).select(*keys, order.alias("_o"), F.explode(tails).alias("name"))
    return p.join(wanted.select(*keys, "name").distinct(), [*keys, "name"]).groupBy(*keys, "name").agg(F.min("_o").alias("_o")).select(*keys, "name", "_o.node")


def seeds_containing(points: DataFrame, names: DataFrame) -> DataFrame:
    """(node): points that contain any of the names, over all versions.

    A point is cut into its parts of the lengths that names have, which meet the names in an equi join.
    """
    names = names.select("name").where("name is not null").distinct()
    sizes = names.select(F.length("name").alias("_n")).distinct()
    nodes = points.select("node").distinct()
    # as many rows as there are lengths, far below a name's length
    parts = nodes.join(sizes, F.length("node") >= F.col("_n")).select("node", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("node") - F.col("_n") + 1), lambda i: F.substring(F.col("node"), i, F.col("_n"))))).alias("name"))
    return parts.join(names, "name", "left_semi").select("node").distinct()


def touching(edges: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Edges with either end among the nodes, as often as they occur: two semi joins rather than one with OR."""
    src = edges.join(nodes.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi")
    rest = edges.join(nodes.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti")
    return src.unionByName(rest.join(nodes.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi"))


def window_flows(nodes: DataFrame, key: str, name: str, line: str, lo: Column, hi: Column, sink: Column | None = None, span: int = 4096) -> DataFrame:
    """(key, name, src_line, dst_line): pairs of nodes of one key and name, the second strictly inside the first's window.

    lo and hi are columns of the source row (use the alias s); `sink`, a condition on the second row (alias d), narrows
    what may be reached. Lines are dealt to buckets of `span`, about as wide as the windows: a source looks into those
    its window touches, so that a key with very many nodes is cut into many groups, none wider than a window.
    """
    s, d = nodes.alias("s"), nodes.alias("d")
    bucket = lambda x: F.floor(x / span)
    s = s.withColumn("_b", F.explode(F.when(hi >= lo, F.sequence(bucket(lo), bucket(hi))))).alias("s")
    d = d.withColumn("_b", bucket(F.col(line))).alias("d")
    on = (F.col("s._b") == F.col("d._b")) & (F.col(f"s.{key}") == F.col(f"d.{key}")) & (F.col(f"d.{line}") > lo) & (F.col(f"d.{line}") < hi)
    if sink is None:
        on = on & (F.col(f"s.{name}") == F.col(f"d.{name}"))
    else:
        on = on & sink
    return s.join(d, on).select(F.col(f"s.{key}").alias(key), F.col(f"s.{name}").alias(name), F.col(f"s.{line}").alias("src_line"), F.col(f"d.{line}").alias("dst_line"))


def sources_or_earlier(nodes: DataFrame, src_lines: DataFrame, dst_lines: DataFrame, *keys: str) -> DataFrame:
    """Nodes on the wanted source lines of their key; keys without any get the nodes before some target line instead."""
    at = nodes.join(src_lines, [*keys, "line"], "left_semi")
    none = nodes.join(at.select(*keys).distinct(), [*keys], "left_anti")
    last = dst_lines.groupBy(*keys).agg(F.max("line").alias("_last"))
    return at.unionByName(none.join(last, [*keys]).where(F.col("line") < F.col("_last")).drop("_last"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank): PageRank by repeated joins; weight of nodes without outgoing edges is spread over all."""
    e = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = checkpointed(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(None).cast("double"))
    deg = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    nodes = checkpointed(nodes.join(deg, "node", "left"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = rank.join(e, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        lost = rank.where("deg is null").agg(F.sum("rank")).first()[0] or 0.0
        rank = nodes.join(given, F.col("node") == F.col("dst"), "left").select("node", "deg", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        rank = checkpointed(rank)
    return rank.select("node", "rank")


def select_nodes(nodes: DataFrame, *types: str) -> DataFrame:
    """Nodes (doc, id, parent, field, type, start_byte, end_byte) of the given types."""
    return nodes.where(F.col("type").isin(*types))


def children(nodes: DataFrame, parents: DataFrame, type: str | None = None, first: bool = False) -> DataFrame:
    """Children of the parents (doc, id), of one type if given; with first, only the earliest of each parent."""
    c = nodes.join(parents.select("doc", F.col("id").alias("parent")), ["doc", "parent"], "left_semi")
    c = c if type is None else c.where(F.col("type") == type)
    if not first:
        return c
    best = c.groupBy("doc", "parent").agg(F.min(F.struct("start_byte", "id")).alias("_f"))
    return c.join(best, ["doc", "parent"]).where(F.struct("start_byte", "id") == F.col("_f")).drop("_f")


def distinct_nodes(nodes: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each id of a sparse node table: identity is the id; the least `order` wins where given."""
    if order is None:
        return nodes.dropDuplicates(["id"])
    first = nodes.groupBy("id").agg(F.min(order).alias("_o"))
    return nodes.join(first, "id").where(F.col(order) == F.col("_o")).drop("_o").dropDuplicates(["id"])


def pre_order(nodes: DataFrame, *keys: str) -> DataFrame:
    """nodes with `order`, from 0: their place in a walk that takes a node before its children, these from left to right.

    A node begins no later than its children and ends no earlier; of nodes over the same bytes the outer one has the
    smaller depth, so (start, -end, depth, id) is this order, but that an
    empty node comes after a sibling that begins where it does. Nodes are (keys, id, depth, start_byte, end_byte).
    """
    w = Window.partitionBy(*keys).orderBy("start_byte", F.col("end_byte").desc(), "depth", "id")
    return nodes.withColumn("order", F.row_number().over(w) - 1)


def captures(nodes: DataFrame, wanted: dict[str, tuple[str, ...]], *keys: str) -> DataFrame:
    """(keys, capture, id, type, start_byte, end_byte) of nodes (type) for each capture's types, a stand-in for queries
    on syntax trees; a node is in as many captures as name its type."""
    names = F.create_map(*[F.lit(x) for t in sorted({t for ts in wanted.values() for t in ts}) for x in (t, "\x01".join(sorted(c for c, ts in wanted.items() if t in ts)))])
    return nodes.withColumn("capture", F.explode(F.split(F.try_element_at(names, F.col("type")), "\x01"))).select(*keys, "capture", "id", "type", "start_byte", "end_byte")
