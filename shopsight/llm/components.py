"""Connected components of an edge table, by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.session import materialize

#: Rows of ids that a task of a small table takes.
TASK_ROWS = 100_000


def narrowed(df: DataFrame, rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """A frame of at most so many rows, in no more tasks than these need, whatever the shuffle width."""
    return df.coalesce(-(-max(rows, 1) // per_task))


def labelled(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """Add a node's label; a node without one is its own."""
    of = labels.select(F.col("node").alias(node), F.col("label").alias(label))
    return df.join(of, node, "left").withColumn(label, F.coalesce(label, node))


def least_labels(edges: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """node and label: the least node reachable, for every node of an edge.

    Each round takes the least label among a node's neighbours and then the
    label of that label; labels only fall, so rounds end when their sum stays.
    Every round's labels are a stored table, so a lost executor costs a round at
    most; a node's neighbours are aggregated and never gathered. ``known`` has the
    labels over earlier edges: only edges between two of its components are
    followed, as edges between their labels, and its labels are carried over.
    """
    edges = materialize(edges)
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    if known is not None:
        pairs = labelled(labelled(pairs, known, "node", "x"), known, "other", "y").where("x <> y").select(F.col("x").alias("node"), F.col("y").alias("other"))
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    pairs = materialize(narrowed(pairs, 2 * edges.count()))
    rows = pairs.count()
    if not rows:
        return pairs.select("node", F.col("other").alias("label")) if known is None else known
    labels = _spread(pairs, rows)
    if known is None:
        return labels
    moved = labels.select(F.col("node").alias("label"), F.col("label").alias("least"))
    carried = known.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return materialize(narrowed(carried.unionByName(labels.join(known, "node", "left_anti")), known.count() + rows))


def _spread(pairs: DataFrame, rows: int) -> DataFrame:
    """The least labels over stored pairs (node, other), which come both ways."""
    labels = materialize(narrowed(pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), rows))
    while True:
        heard = pairs.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("before"))
        lower = materialize(narrowed(lower, rows))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        jumped = lower.join(jump, "label", "left").select("node", F.coalesce("jumped", "label").alias("label"), "before")
        jumped = materialize(narrowed(jumped, rows))
        if jumped.where(F.col("label") != F.col("before")).isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
