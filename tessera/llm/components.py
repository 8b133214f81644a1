"""Connected components of a table of edges: local spanning forests, then alternating large and small stars.

A round first lets every task replace its edges, ``AT_ONCE`` at a time, by a spanning forest of stars: that keeps who
reaches whom, never adds an edge, and joins what lies within a task at once. Large and small stars then carry labels between tasks, which bounds the
rounds by the logarithm of the longest path even where each task sees a single edge of a component. A node's edges are dealt
over several tasks in every star, so a hub of a third of all edges makes no task large. Labels never leave the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, with_totals

AT_ONCE = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes of edges u, v; nodes that are the smallest themselves are left out."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # each end's root hooks to the smaller root, then paths are halved until they are flat
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(flat := new[new], new):
            new = flat
        if np.array_equal(new, label):
            far = np.flatnonzero(label != np.arange(len(names)))
            return names[far], names[label[far]]
        label = new


def _forests(batches):
    held, size = [], 0

    def out():
        u, v = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= AT_ONCE:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links a node's larger neighbours (large star), or its smaller ones and itself (small star), to the smallest of its neighbours and itself."""
    turned = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.inline(turned)) if large else edges
    met = with_totals(both, ["u"], ["v"], _m=("min", "v")).withColumn("_m", F.least("u", "_m"))
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    linked = F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct(F.col("u"), F.col("_m").alias("v")))
    return met.select(F.inline(linked)).where(F.col("u") > F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none."""
    rows, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return rows == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (u, v) bigints, in any order. Gives (node, component): the smallest node that each node on an edge can reach."""
    spark, old = edges.sparkSession, []
    ordered = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(ordered.mapInArrow(_forests, "u bigint, v bigint").distinct())
    for _ in range(most_rounds):
        if _settled(now):
            release(spark, *old)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        old.append(now.stored_path)
        now = stored(_star(_star(now.mapInArrow(_forests, "u bigint, v bigint"), True), False))
    raise RuntimeError("components did not settle")


def joined_components(label: DataFrame, more: DataFrame) -> DataFrame:
    """The components of label, (node, component), once the links of more, (u, v), are added: only the components that a link joins are worked on."""
    of = lambda name: label.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
    across = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    merged = components(across)
    # a node that only more has is a component of its own in label
    nodes = label.unionByName(merged.join(label, "node", "left_anti").select("node", F.col("node").alias("component")))
    return nodes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
