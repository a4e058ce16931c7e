"""Connected components: randomised contraction, label propagation with pointer doubling, breadth-first peeling.

Every method returns (vertex, component), the component being its smallest vertex id.
A vertex is known only through an edge; a self-loop makes a component of one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.session import Growing, cut, cut_counted, release


#: Edges, of 16 bytes, that one task labels.
AT_HAND = 1 << 16
#: Rows of forests that one task labels when asked to do so: their vertices and what joins them take half a gigabyte.
SEQUENTIAL = 3 << 22
#: Edges that a task takes at a time.
BLOCK = 1 << 20


def symmetrise(edges: DataFrame) -> DataFrame:
    """Each edge both ways, as a multiset, in one pass without a shuffle."""
    ends = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ends).alias("e")).select("e.src", "e.dst")


def _order(turn: int, vertex: str) -> Column:
    return F.xxhash64(F.lit(turn), vertex)


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least vertex that each of 0..n-1 reaches over edges a - b: labels go down edges and are looked up through labels."""
    label = np.arange(n)
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    return label


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(src, dst) of the batches, about size edges at a time."""
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= size:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what src - dst connect: each vertex and the least that it reaches, one that is alone with itself."""
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    label = _least(at[: len(src)], at[len(src) :], len(names))
    out = (label != np.arange(len(names))) | (np.bincount(label, minlength=len(names)) == 1)
    return names[out], names[label[out]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst): the forest of each block of edges."""
    for src, dst in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(src, dst)], ["src", "dst"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, root) of the edges at hand. What is held are the vertices and their roots, 12 bytes each, and one block of edges;
    a block joins the roots of its ends."""
    names, root = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for src, dst in _blocks(batches):
        ends, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        place = np.searchsorted(names, ends)
        new = np.ones(len(ends), bool)
        inside = place < len(names)
        new[inside] = names[place[inside]] != ends[inside]
        if new.any():
            # where the vertices that are there move to, by how many new ones come before them
            to = np.bincount(place[new], minlength=len(names) + 1)[: len(names)].cumsum(dtype=np.int32)
            to += np.arange(len(names), dtype=np.int32)
            merged, above = np.empty(len(names) + int(new.sum()), np.int64), np.arange(len(names) + int(new.sum()), dtype=np.int32)
            fresh = np.ones(len(merged), bool)
            merged[to], above[to], fresh[to] = names, to[root], False
            merged[fresh] = ends[new]
            names, root = merged, above
            place = np.searchsorted(names, ends)
        tops, of = np.unique(root[place], return_inverse=True)
        label = tops[_least(of[at[: len(src)]], of[at[len(src) :]], len(tops))]
        if (label != tops).any():
            up = np.arange(len(names), dtype=np.int32)
            up[tops] = label
            root = up[root]
    for k in range(0, len(names), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array(names[k : k + BLOCK]), pa.array(names[root[k : k + BLOCK]])], ["vertex", "root"])


def sequential_components(edges: DataFrame, most: int = SEQUENTIAL) -> DataFrame:
    """Union-find in one task, over blocks' spanning forests in place of the edges.

    The task holds the vertices, not the edges. Beyond most rows of forests, what would not fit a task is contracted first.
    """
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    return contract_components(ends.mapInArrow(_forest, "src long, dst long"), most)


def contract_components(edges: DataFrame, at_hand: int = AT_HAND, max_rounds: int = 500) -> DataFrame:
    """Randomised contraction (Boegeholz, Brand and Todor 2020): every vertex hooks onto the least of its closed neighbourhood
    in a random order, new in each round, and edges move to the ends' choices.

    A round is one partially aggregated minimum and two equi-joins on unique keys, whose edge side the adaptive skew
    join may split at a hub; vertices at least halve on paths and shrink faster elsewhere, so that all rounds together cost
    about two of the first. The last at_hand edges or fewer, a megabyte, are labelled in one task, which saves the rounds that
    have next to nothing to do; 0 leaves none to it. The choices are then composed from the last round back, and each component takes the name of its least vertex.
    """
    ends = edges.select(F.greatest(F.col("src").cast("long"), F.col("dst").cast("long")).alias("src"), F.least(F.col("src").cast("long"), F.col("dst").cast("long")).alias("dst"), (F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("whole"))
    clean = cut(ends.where("whole").select("src", "dst"), n=F.count_if(F.col("src") != F.col("dst")), loops=F.count_if(F.col("src") == F.col("dst")))
    now, n, hooks = clean.where("src <> dst"), clean.marks["n"], []
    while n:
        if len(hooks) == max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        turn = len(hooks)
        if n <= at_hand:
            hooks.append(cut(now.coalesce(1).mapInArrow(_finished, "vertex long, root long")))
            break
        # hooks are kept apart from the joins: only a join of two plain shuffles lets a hub's edges be split over tasks
        near = symmetrise(now).withColumn("h", _order(turn, "dst")).groupBy(F.col("src").alias("vertex")).agg(F.min("h").alias("h"), F.min_by("dst", "h").alias("to"))
        hook = cut(near.select("vertex", F.when(_order(turn, "vertex") <= F.col("h"), F.col("vertex")).otherwise(F.col("to")).alias("root")))
        hooks.append(hook)
        a, b = hook.select(F.col("vertex").alias("va"), F.col("root").alias("a")), hook.select(F.col("vertex").alias("vb"), F.col("root").alias("b"))
        moved = now.join(a, F.col("src") == F.col("va")).join(b, F.col("dst") == F.col("vb")).where("a <> b")
        after, n = cut_counted(moved.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
        if turn:
            release(now)
        now = after
    empty = edges.sparkSession.createDataFrame([], "vertex long, root long")
    labels = hooks[-1] if hooks else empty
    for k, hook in enumerate(reversed(hooks[:-1]), 1):
        up = labels.select(F.col("vertex").alias("v"), F.col("root").alias("top"))
        labels = hook.join(up, F.col("root") == F.col("v"), "left").select("vertex", F.coalesce("top", "root").alias("root"))
        if k % 4 == 0:
            labels = cut(labels)
    labels = cut(labels)
    least = cut(labels.groupBy(F.col("root").alias("r")).agg(F.min("vertex").alias("component")))
    named = labels.join(least, F.col("root") == F.col("r")).select("vertex", "component")
    if clean.marks["loops"]:
        alone = clean.where("src = dst").select(F.col("src").alias("vertex")).distinct().join(labels, "vertex", "left_anti")
        named = named.unionAll(alone.select("vertex", F.col("vertex").alias("component")))
    return named


def label_components(edges: DataFrame, doubling: bool = True, prune_stable: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """Min-label propagation; doubling looks labels up through labels, prune_stable freezes finished components.

    A component is finished when no edge joins two labels and every label is a root; its rows then leave the
    working set. That pass over the edges is made in rounds that moved less than a quarter of the labels.
    """
    spark = edges.sparkSession
    e = cut(symmetrise(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")).distinct())
    labels = cut(e.groupBy(F.col("src").alias("vertex")).agg(F.least(F.col("vertex"), F.min("dst")).alias("component")))
    done = Growing(spark, "vertex long, component long")
    for _ in range(max_rounds):
        step = label_step(e, labels)
        if doubling:
            step = cut(step)
            step = parent_step(step)
        step = cut(step, n=F.count(F.lit(1)), moved=F.count_if(F.col("next") != F.col("component")))
        n, moved = step.marks["n"], step.marks["moved"]
        labels = step.select("vertex", F.col("next").alias("component"))
        if not moved:
            done.add(labels)
            return done.all()
        if prune_stable and 4 * moved < n:
            live = step.where("next <> component").select(F.col("next").alias("component"))
            at = labels.select(F.col("vertex").alias("v"), F.col("component").alias("c"))
            torn = e.join(at, e.src == at.v).select("dst", F.col("c").alias("c1")).join(at, F.col("dst") == at.v).where("c1 <> c")
            live = cut(live.union(torn.select("c1")).union(torn.select("c")).distinct())
            done.add(labels.join(live, "component", "left_anti").select("vertex", "component"))
            labels = cut(labels.join(live, "component", "left_semi").select("vertex", "component"))
            e = cut(e.join(labels.select(F.col("vertex").alias("src")), "src", "left_semi"))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def label_step(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(vertex, component, next) of labels (vertex, component): next is the least label of a vertex and its neighbours."""
    heard = edges.join(labels, edges.src == labels.vertex).groupBy(F.col("dst").alias("vertex")).agg(F.min("component").alias("heard"))
    return labels.join(heard, "vertex", "left").select("vertex", "component", F.least("component", "heard").alias("next"))


def parent_step(step: DataFrame) -> DataFrame:
    """step (vertex, component, next) with next looked up through itself: the label of the vertex that names the label."""
    up = step.select(F.col("vertex").alias("at"), F.col("next").alias("above"))
    return step.join(up, step.next == up.at, "left").select("vertex", "component", F.least("next", "above").alias("next"))
