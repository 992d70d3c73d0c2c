"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C


#: Links that one task puts together at once, 16 bytes each; more are contracted by joins first.
FINISH = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n ids the least that links (a, b) reach: roots are hooked to lesser ones, then paths are halved."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b) to (id, to), to being the least id of id's component."""
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    to = ids[least_labels(place[: len(a)], place[len(a) :], len(ids))]
    for s in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + (1 << 16)]), pa.array(to[s : s + (1 << 16)])], ["id", "to"])


def components(links: DataFrame, bag: list[str] | None = None) -> DataFrame:
    """(id, comp) for each id in links (a, b): comp is the least id that can be reached.

    While there are more than FINISH links, a round maps every id to the least of its neighbours and itself, and the
    links to links between what their ends map to; those that fall together go, so the links shrink by a factor a round
    for ids in random order, as hashes are. Rounds are aggregations and joins on ids: nothing is gathered. The links
    left, a bounded number, are put together by one task on an executor; the rounds' maps follow, from the last to the
    first. Each step is written to the shared folder. Null ends and loops are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = C.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges", bag)
    maps = []
    while edges.count() > FINISH:
        ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
        step = C.cut(ends.groupBy("id").agg(F.min("a").alias("to")), "step", bag)
        maps.append(step)
        a, b = (step.select(F.col("id").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").where("_a <> _b")
        edges = C.cut(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges", bag)
    labels = C.cut(edges.coalesce(1).mapInArrow(_finish, "id long, to long"), "labels", bag).withColumnRenamed("to", "comp")
    for step in reversed(maps):
        up = labels.withColumnRenamed("id", "to")
        inner = step.join(up, "to", "left").select("id", F.coalesce("comp", "to").alias("comp"))
        labels = C.cut(inner, "labels", bag)
    return labels
