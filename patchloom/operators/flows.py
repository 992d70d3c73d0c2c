"""Flows over edge tables: what is reachable from each source, by which path, and ranks around seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.operators import graph as G
from patchloom.session import checkpointed

#: Rounds after which what has been found so far is written as one table, so that plans don't grow with the depth.
EVERY = 6


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, *keys: str, window: Column | None = None, hops: int = 1000, prune: bool = True) -> DataFrame:
    """(keys, source, sink, hops, path): for each source and each sink that it reaches the shortest path between them.

    edges are (keys, src, dst), sources and sinks (keys, node, ...); every key is a graph of its own. window is a condition
    on a source (alias s) and a sink (alias d), such as one on their lines; sinks that fail it may still lie on a path. A
    source is no sink of its own. Of several shortest paths the one whose nodes, from the sink back, are least is given.

    A frontier carries each source on: a round joins it with the edges, takes out the nodes that the source has met, and
    keeps with each new node the least one it came from. So cycles end it, sources that share nodes are walked side by
    side, and rows are pairs of a source and a node, not paths. Paths are put together backwards from the sinks met. With
    prune, only nodes from which a sink can be reached are walked. Flows of over `hops` edges are not looked for.
    """
    e = edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct()
    if prune:
        back = e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        # of a flow's edges the first ends at most hops - 1 edges before its sink
        useful = G.reach(back, sinks.select(*keys, "node"), *keys, limit=max(hops, 1000), within=max(hops - 1, 0) if hops < 1000 else None)
        e = e.join(useful.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi")
    if hops <= EVERY:
        return _short_flows(e, sources, sinks, *keys, window=window, hops=hops)
    e = checkpointed(e)
    found = new = checkpointed(sources.select(*keys, F.col("node").alias("source"), "node").where("node is not null").distinct().withColumns({"parent": F.lit(None).cast(sources.schema["node"].dataType), "hop": F.lit(0)}))
    depth = 0
    while depth < hops:
        step = new.select(*keys, "source", F.col("node").alias("src")).join(e, [*keys, "src"])
        step = step.groupBy(*keys, "source", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        step = step.join(found.select(*keys, "source", "node"), [*keys, "source", "node"], "left_anti")
        new = checkpointed(step.select(*keys, "source", "node", "parent", F.lit(depth + 1).alias("hop")))
        if new.isEmpty():
            break
        depth += 1
        found = found.unionByName(new)
        if depth % EVERY == 0:
            found = checkpointed(found)
    on = lambda a, b, cols: [F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x, y in cols]
    same = [(k, k) for k in keys]
    met = found.where("hop > 0 and node <> source").alias("f")
    met = met.join(sinks.alias("d"), on("f", "d", [*same, ("node", "node")])).join(sources.alias("s"), on("f", "s", [*same, ("source", "node")]))
    met = met if window is None else met.where(window)
    met = met.select(*[F.col(f"f.{k}") for k in keys], F.col("f.source"), F.col("f.node").alias("sink"), F.col("f.hop").alias("hops"), F.array("f.node").alias("path"), F.col("f.parent").alias("at")).distinct()
    ways = found.select(*keys, "source", F.col("node").alias("at"), F.col("parent").alias("before"))
    for i in range(depth):
        met = met.join(ways, [*keys, "source", "at"], "left")
        met = met.select(*keys, "source", "sink", "hops", F.when(F.col("at").isNull(), F.col("path")).otherwise(F.array_prepend("path", F.col("at"))).alias("path"), F.col("before").alias("at"))
        if (i + 1) % EVERY == 0:
            met = checkpointed(met)
    return met.select(*keys, "source", "sink", "hops", "path")


def _short_flows(e: DataFrame, sources: DataFrame, sinks: DataFrame, *keys: str, window: Column | None, hops: int) -> DataFrame:
    """flows() of few edges: rows carry their path and are not compared with what earlier rounds found.

    A round's row for a source and a node has the least of the nodes it came from. If no earlier round met the node, these
    are all nearest nodes by rights, so its path is that of flows(); of the rounds that met it the first is taken at the end.
    A path that comes back to a node of its own is given up. The last edge is one that leads to a sink.
    """
    nodes = sources.select(*keys, F.col("node").alias("source"), "node").where("node is not null").distinct()
    new, rounds = nodes.withColumn("path", F.array("node")), []
    goals = sinks.select(*keys, F.col("node").alias("dst")).distinct().withColumn("_goal", F.lit(True))
    e = checkpointed(e.join(goals, [*keys, "dst"], "left").withColumn("_goal", F.col("_goal").isNotNull()))
    for hop in range(1, hops + 1):
        ahead = e if hop < hops else e.where("_goal")
        step = new.withColumnRenamed("node", "src").join(ahead, [*keys, "src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.groupBy(*keys, "source", F.col("dst").alias("node"), "_goal").agg(F.min(F.struct("src", "path")).alias("_from"))
        step = checkpointed(step.select(*keys, "source", "node", F.concat("_from.path", F.array("node")).alias("path"), "_goal"))
        rounds.append(step.where("_goal").drop("_goal").withColumn("hops", F.lit(hop)))
        new = step.drop("_goal")
    if not rounds:
        rounds = [new.withColumn("hops", F.lit(0)).limit(0)]
    on = lambda a, b: [F.col(f"f.{k}") == F.col(f"{b}.{k}") for k in keys] + [F.col(f"f.{a}") == F.col(f"{b}.node")]
    met = reduce(DataFrame.unionByName, rounds).alias("f").join(sinks.alias("d"), on("node", "d")).join(sources.alias("s"), on("source", "s"))
    met = met if window is None else met.where(window)
    first = met.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], F.col("f.source").alias("source"), F.col("f.node").alias("sink")).agg(F.min(F.struct("f.hops", "f.path")).alias("_first"))
    return first.select(*keys, "source", "sink", "_first.hops", "_first.path")


def identifier_flows(nodes: DataFrame, edges: DataFrame, asked: DataFrame, *keys: str, to_returns: bool = True, **options) -> DataFrame:
    """Flows from an identifier to what a change may reach: (keys, source, sink, hops, path).

    nodes are (keys, node, name, line, is_return), asked (keys, name, src_line, dst_line): from identifiers of that name on
    src_line, to the returns strictly between the lines, or without to_returns to identifiers of the same name there.
    """
    starts = nodes.join(asked, [*keys, "name"]).where(F.col("line") == F.col("src_line")).select(*keys, "node", "name", "src_line", "dst_line")
    ends = nodes.where("is_return") if to_returns else nodes.where("not coalesce(is_return, false)")
    between = (F.col("d.line") > F.col("s.src_line")) & (F.col("d.line") < F.col("s.dst_line"))
    window = between if to_returns else between & (F.col("d.name") == F.col("s.name"))
    return flows(edges, starts, ends.select(*keys, "node", "name", "line"), *keys, window=window, **options)


def neighbourhood(edges: DataFrame, seeds: DataFrame, *keys: str, of: str = "set", jumps: int = 3, directed: bool = False) -> DataFrame:
    """(keys, of, node, jump): for each set of seeds the nodes within `jumps` edges of one, and how far the nearest is.

    edges are (keys, src, dst), seeds (keys, of, node). All sets are walked at once; directed follows edges one way only.
    """
    e = edges.select(*keys, "src", "dst")
    e = e if directed else e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = checkpointed(e.distinct())
    found = new = checkpointed(seeds.select(*keys, of, "node").distinct().withColumn("jump", F.lit(0)))
    for i in range(1, jumps + 1):
        step = new.withColumnRenamed("node", "src").join(e, [*keys, "src"]).select(*keys, of, F.col("dst").alias("node")).distinct()
        new = checkpointed(step.join(found, [*keys, of, "node"], "left_anti").withColumn("jump", F.lit(i)))
        found = found.unionByName(new)
    return found


def seeded_ranks(edges: DataFrame, seeds: DataFrame, *keys: str, of: str = "set", jumps: int = 3, damping: float = 0.85, rounds: int = 20, directed: bool = False) -> DataFrame:
    """(keys, of, node, rank): PageRank with restarts at each set of seeds, within `jumps` edges of the set.

    A set's graph has the nodes of its neighbourhood and the edges between them. A walk begins at a seed, each as likely,
    goes on along an edge with probability `damping` and else begins anew; so it does at nodes without edges to go on by.
    The ranks of a set add up to one. A round is one join and one aggregation in which restarts are rows like any other,
    so no round needs a number from an earlier one, and a job runs every few rounds only.
    """
    ks = [*keys, of]
    near = checkpointed(neighbourhood(edges, seeds, *keys, of=of, jumps=jumps, directed=directed))
    nodes = near.select(*ks, "node")
    e = edges.select(*keys, "src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), [*keys, "src"])
    e = e.join(nodes.withColumnRenamed("node", "dst"), [*ks, "dst"], "left_semi")
    deg = e.groupBy(*ks, "src").agg(F.count(F.lit(1)).alias("deg"))
    e = checkpointed(e.join(deg, [*ks, "src"]).select(*ks, F.col("src").alias("node"), "dst", (F.lit(damping) / F.col("deg")).alias("share")))
    stuck = checkpointed(nodes.join(deg.withColumnRenamed("src", "node"), [*ks, "node"], "left_anti"))
    starts = near.where("jump = 0").select(*ks, "node")
    starts = checkpointed(starts.join(starts.groupBy(*ks).agg((1 / F.count(F.lit(1))).alias("part")), ks))
    begin = starts.select(*ks, "node", (F.col("part") * (1 - damping)).alias("rank"))
    rank = starts.select(*ks, "node", F.col("part").alias("rank"))
    for i in range(rounds):
        given = rank.join(e, [*ks, "node"]).select(*ks, F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("rank"))
        lost = rank.join(stuck, [*ks, "node"]).groupBy(*ks).agg(F.sum("rank").alias("_lost"))
        anew = starts.join(lost, ks).select(*ks, "node", (F.col("part") * F.col("_lost") * damping).alias("rank"))
        rank = given.unionByName(anew).unionByName(begin).groupBy(*ks, "node").agg(F.sum("rank").alias("rank"))
        if (i + 1) % 4 == 0:
            rank = checkpointed(rank)
    return nodes.join(rank, [*ks, "node"], "left").select(*ks, "node", F.coalesce("rank", F.lit(0.0)).alias("rank"))
