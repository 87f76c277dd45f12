"""Connected components of a graph whose edges never leave the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelight.llm.common import discard, stored
from porelight.runtime import ship_package

#: Most edges that one task takes; with nodes of 16 bytes they are some 20 MB there.
FEW = 1 << 18


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 to ``n`` - 1 that each reaches by the edges between ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((up := label[label]) != label).any():
            label = up


def few_components(edges: DataFrame) -> DataFrame:
    """(node, root, hub, n) of (a, b) edges that are ``FEW`` at most, by one task: rounds over a small
    graph cost a job and tasks for every partition each. ``root`` is the least node of the component,
    ``hub`` the one with most edges (the greatest of several), ``n`` counts its nodes."""
    ship_package(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        ends = [(batch.column("a"), batch.column("b")) for batch in batches if batch.num_rows]
        if not ends:
            return
        coded = pa.chunked_array([x for pair in zip(*ends) for x in pair]).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        nodes, n = coded.dictionary.take(order), len(order)
        rank = np.empty(n, np.int64)
        rank[order.to_numpy()] = np.arange(n)
        a, b = np.split(rank[coded.indices.to_numpy()], 2)
        root, degree = least_labels(a, b, n), np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        by = np.lexsort((degree, root))  # stable, so the greatest node is the last of one degree
        last = np.append(root[by][1:] != root[by][:-1], True)
        hub = np.zeros(n, np.int64)
        hub[root[by][last]] = by[last]
        out = pa.Table.from_arrays([nodes, nodes.take(pa.array(root)), nodes.take(pa.array(hub[root])), pa.array(np.bincount(root, minlength=n)[root])], ["node", "root", "hub", "n"])
        yield from out.to_batches(max_chunksize=10_000)

    return edges.select("a", "b").where("a != b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}, hub {kind}, n long")


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(a, b) edges to (node, root): the least node that each node can reach, for nodes that have an edge.

    Up to ``few`` edges, which then have to be cheap to count, go to one task.

    Each round takes the least label among a node's neighbours and then follows
    the label's own label, so long chains halve. The table of a round is written
    and read again rather than checkpointed: a checkpoint carries on the
    constraints of the plans before it, which double from round to round, and a
    table has a size by which a join can choose to broadcast. Both joins have
    unique keys on one side, so a node or label that very many rows share is split
    by adaptive execution.
    """
    if few and edges.count() <= few:
        return few_components(edges).select("node", "root")
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"), F.lit(True).alias("moved")))
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        least = both.join(known, "b").groupBy("a").agg(F.min("seen").alias("seen")).withColumnRenamed("a", "node")
        hooked = stored(labels.select("node", "root").join(least, "node").select("node", "root", F.least("root", "seen").alias("hook")))
        onward = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("next"))
        before, labels = labels, stored(hooked.join(onward, "hook").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        discard(before, hooked)
        if not labels.where("moved").head(1):
            discard(both)
            return labels.select("node", "root")
