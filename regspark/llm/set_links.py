"""Links between similar sets of a cluster, exact, without comparing all of a large cluster with all.

The sets of a small cluster meet in one chunk.  In a large one a few sets in
turn represent it: each is compared with all others, and those similar to it
get its label.  Sets with one label are connected, so they are not compared
among themselves.  Jaccard distance is a metric: what is further from a
representative than twice the distance of a link has no link to any set with
its label, so these are not compared either.  The rest is cut in chunks by
label and by which labels it is far from, and all pairs of chunks that are
left are compared in full, each in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .simhash import Links

#: Similarity of a link, and of a set that may still have a link to one that is similar to a third (1 - 2 * (1 - 0.8)).
LEAST, FAR = (4, 5), (3, 5)
#: A chunk's shingles, with so many more for each set.
CHUNK, EACH = 200_000, 64
ROUNDS = 3


def similar_sets(x: pa.StructArray, y: pa.StructArray | None, links: Links) -> None:
    """Add the links between the (node, shingles) of two chunks, or within one."""
    own = y is None
    y = x if own else y
    (nodes_x, sets_x), (nodes_y, sets_y) = ((c.field(0).to_numpy(), c.field(1)) for c in (x, y))
    size_x, size_y = (np.asarray(s.value_lengths(), np.int64) for s in (sets_x, sets_y))
    all_x, all_y = (s.flatten().to_numpy() for s in (sets_x, sets_y))
    known, place = np.unique(all_y, return_inverse=True)
    begin = np.cumsum(size_y) - size_y
    at = 0
    for i, size in enumerate(size_x.tolist()):
        mine = all_x[at : at + size]
        at += size
        first = i + 1 if own else 0
        if first == len(size_y):
            break
        spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        has = np.zeros(len(known), np.int64)
        has[spot[known[spot] == mine]] = 1
        both = np.add.reduceat(has[place[begin[first] :]], begin[first:] - begin[first])
        near = first + np.flatnonzero(LEAST[1] * both >= LEAST[0] * (size + size_y[first:] - both))
        links.add(np.full(len(near), nodes_x[i]), nodes_y[near])


def compared(members: DataFrame, reps: DataFrame, step: int) -> DataFrame:
    """`members` with `near` and `far` of the representative of their cluster, in round `step`."""
    kind = "node long, root long, shingles array<long>, label int, mask int"
    both = members.join(reps, "root").select("node", "root", "shingles", "label", "mask", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, mask = np.array(batch.column(3)), np.array(batch.column(4))
            sets, reps = batch.column(2), batch.column(5)
            for k in range(batch.num_rows):
                x, y = sets[k].values.to_numpy(), reps[k].values.to_numpy()
                has = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - has
                if LEAST[1] * has >= LEAST[0] * union and not label[k]:
                    label[k] = step
                if FAR[1] * has < FAR[0] * union:
                    mask[k] |= 1 << step
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(label), pa.array(mask)], names=["node", "root", "shingles", "label", "mask"])

    return both.mapInArrow(run, kind)


def chunk_links(pairs: DataFrame) -> DataFrame:
    """Links between `own` and `theirs`, or within `own` where `theirs` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (c.slice(k, 1).flatten() if c.slice(k, 1)[0].is_valid else None for c in batch.columns)
                similar_sets(x, y, links)
        a, b = links.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("own", "theirs").mapInArrow(run, "a long, b long")


def similar_within(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all similar pairs of sets (node, shingles) within a cluster (node, root) connect."""
    spark = sets.sparkSession
    bounded_batches(spark, rows=200)
    members = written(sets.join(clusters, "node").select("node", "root", "shingles", F.lit(0).alias("label"), F.lit(0).alias("mask")), "members")
    weight = F.size("shingles") + EACH
    sizes = written(members.groupBy("root").agg(F.sum(weight).alias("weight")), "weights")
    large = written(sizes.where(F.col("weight") > CHUNK).select("root"), "large")
    state = written(members.join(large, "root", "left_semi").select(members.columns), "state0")
    named = []
    for step in range(1, ROUNDS + 1) if not large.isEmpty() else ():
        free = state.where("label = 0")
        reps = written(free.groupBy("root").agg(F.min(F.struct("node", F.col("shingles").alias("rep"))).alias("r")).select("root", "r.node", "r.rep"), "reps")
        if reps.isEmpty():
            break
        rest = state.join(reps.select("root"), "root", "left_anti").select(state.columns)
        state = written(compared(state, reps.select("root", "rep"), step).unionByName(rest), f"state{step}")
        named.append(reps.select("root", F.lit(step).alias("label"), F.col("node").alias("rep")))
    small = members.join(large, "root", "left_anti").select(members.columns)
    group = ["root", "label", "mask"]
    both = small.unionByName(state)
    # only groups of several chunks are named in a table, so that rows go to their chunk, not to their group first
    parts = both.groupBy(*group).agg(F.ceil(F.sum(weight) / CHUNK).cast("int").alias("m")).where("m > 1")
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("m", F.lit(1))).cast("int")
    chunks = both.join(written(parts, "parts"), group, "left").groupBy(*group, chunk.alias("chunk")).agg(F.collect_list(F.struct("node", "shingles")).alias("own"))
    chunks = written(chunks, "chunks")
    nothing = F.expr("cast(null as array<struct<node:bigint,shingles:array<bigint>>>)")
    within = chunks.where("label = 0").select("own", nothing.alias("theirs"))
    # pairs of chunks by their names alone; what they hold is joined to those that are left
    ids = chunks.join(large, "root", "left_semi").select(*group, "chunk")
    theirs = ids.select("root", *(F.col(c).alias(f"{c}2") for c in ("label", "mask", "chunk")))
    once = F.struct("label", "mask", "chunk") < F.struct("label2", "mask2", "chunk2")
    bit = lambda mask, label: F.expr(f"shiftright({mask}, {label}) % 2 = 1")
    apart = (F.col("label") > 0) & ((F.col("label") == F.col("label2")) | bit("mask2", "label")) | (F.col("label2") > 0) & bit("mask", "label2")
    pairs = written(ids.join(theirs, "root").where(once & ~apart), "pairs")
    name2 = ["root", "label2", "mask2", "chunk2"]
    own2 = chunks.select("root", *(F.col(c).alias(f"{c}2") for c in ("label", "mask", "chunk")), F.col("own").alias("theirs"))
    across = pairs.join(chunks, [*group, "chunk"]).join(own2, name2).select("own", "theirs")
    links = chunk_links(within.unionByName(across))
    for reps in named:
        links = links.unionByName(state.where("label > 0").join(reps, ["root", "label"]).select(F.col("node").alias("a"), F.col("rep").alias("b")))
    return links
