"""SimHash near-dedup at a similarity: wide fingerprints propose pairs in tiles, the shingle sets confirm them.

The operator of `simhash` with another setting, for the corpus pipeline: words
in fives, and documents are near copies from a Jaccard similarity of 0.8 on.
A print of 64 bits can't hold that line (two prints differ in 9.7 bits on
average there, with a deviation of 2.9), so prints have WORDS_WIDE * 64 bits.

Distinct prints are laid out in tiles by the number of shingles, since sets of
that similarity differ in size by a quarter at most; tile pairs further apart
in size, or in population counts by more than the radius, are skipped, and all
others compared in full: numpy exclusive-or and bit counts.  What a task finds
leaves it as a spanning forest, not as all pairs.  The sets of each cluster of
proposals are then compared exactly, those of a large one with representatives
first (`set_links`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8_bytes, written
from .components import components
from .set_links import similar_within
from .simhash import CHUNK, shingle_hashes, stars

SHINGLE = 5
#: Similarity as a fraction, so that the comparison is one of whole numbers.
LEAST = (4, 5)
WORDS_WIDE = 8
#: Differing bits of 512. At similarity 0.8 prints differ in 77.6 on average with a deviation of 8.1, so 116 loses
#: one pair in a million at the line itself and none to speak of above it; sets of a few shingles vary more.
RADIUS, FEW, RADIUS_FEW = 116, 12, 136
#: The first two words are compared for all pairs, the others where these differ in so many bits at most.
FIRST = 44
BANDS = 4
PAIRS_AT_ONCE = 1 << 18
#: Nodes that are sent to all tasks; more of them are joined.
SENT = 200_000
BITS = [f"p{k}" for k in range(WORDS_WIDE)]


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """WORDS_WIDE words of 64 bits, each bit as over half of the distinct shingles have it under the word's own hash."""
    out = np.zeros(WORDS_WIDE, np.uint64)
    for k in range(WORDS_WIDE):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 15):
            x = (shingles[at : at + (1 << 15)] ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * counts > len(shingles)).view(np.uint64)[0]
    return out


def printed(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, t (a hash of the text), node (a hash of its shingle set), n (shingles) and the print's words."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [np.unique(shingle_hashes(x, SHINGLE)) for x in utf8_bytes(batch.column(2))]
            nodes = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            prints = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, WORDS_WIDE).view(np.int64)
            words = [pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WORDS_WIDE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(map(len, sets), pa.int64()), *words], names=["doc_id", "t", "node", "n", *BITS])

    return source.mapInArrow(run, f"doc_id {kind}, t long, node long, n long, " + ", ".join(f"{b} long" for b in BITS))


def spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make up a spanning forest of the nearest ones."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    order = np.argsort(far, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root, picked = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return np.flatnonzero(picked)
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, rx[apart], rank[apart])
        np.minimum.at(best, ry[apart], rank[apart])
        link = order[np.unique(best[best < len(a)])]
        picked[link] = True
        moved, to = stars(rx[link], ry[link])
        new = np.arange(len(nodes))
        new[moved] = to
        root = new[root]


class Proposals:
    """Pairs found so far: (node, node, differing bits) each, kept as a spanning forest."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.held.append(columns)
            self.size += len(columns[0])
        if self.size > 1 << 21:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        if not self.size:
            return (np.zeros(0, np.int64),) * 3
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        link = spanning(*columns)
        self.held, self.size = [tuple(c[link] for c in columns)], len(link)
        return self.held[0]


def compare_tiles(x: list[np.ndarray], y: list[np.ndarray], found: Proposals) -> None:
    """Add the pairs of two tiles, each (node, n, words...), whose prints are near."""
    px, py = (np.stack(t[2:], axis=1).view(np.uint64) for t in (x, y))
    step = max(1, PAIRS_AT_ONCE // max(1, len(py)))
    for at in range(0, len(px), step):
        part = px[at : at + step]
        far = np.bitwise_count(part[:, None, 0] ^ py[None, :, 0])
        far += np.bitwise_count(part[:, None, 1] ^ py[None, :, 1])
        i, j = np.nonzero(far <= FIRST)
        i += at
        small, large = np.minimum(x[1][i], y[1][j]), np.maximum(x[1][i], y[1][j])
        keep = (LEAST[1] * small >= LEAST[0] * large) & (x[0][i] != y[0][j])
        i, j, small = i[keep], j[keep], small[keep]
        far = np.bitwise_count(px[i] ^ py[j]).sum(axis=1, dtype=np.int64)
        keep = far <= np.where(small < FEW, RADIUS_FEW, RADIUS)
        found.add(x[0][i[keep]], y[0][j[keep]], far[keep])


def proposals(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of `nodes` (node, n and the print's words) that connect what all pairs with near prints connect.

    Bands of sizes
    number about twenty times the logarithm of the longest text, which bounds
    the table that is broadcast.
    """
    spark = nodes.sparkSession
    bounded_batches(spark, rows=16)
    counts = sum((F.bit_count(b) for b in BITS), F.lit(0))
    # a little over the fifth, so that rounding can't set two sizes at the line five bands apart
    band = F.floor(F.log(F.col("n").cast("double")) * (BANDS / np.log(1.2501))).cast("int")
    tiled = nodes.where("n > 0").select("node", "n", *BITS, band.alias("tile"), counts.alias("ones"))
    size = F.greatest(F.lit(CHUNK[0]), F.least(F.lit(CHUNK[1]), (32 * F.sqrt(F.col("count"))).cast("int")))
    tiles = written(tiled.groupBy("tile").count().select("tile", F.ceil(F.col("count") / size).cast("int").alias("m")), "tiles")
    chunk = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    own = F.collect_list(F.struct("node", "n", *BITS)).alias("own")
    chunks = written(tiled.join(F.broadcast(tiles), "tile").groupBy("tile", chunk.alias("chunk")).agg(own, F.min("ones").alias("low"), F.max("ones").alias("high")), "chunks")
    near = tiles.select("tile", F.explode(F.array(*map(F.lit, range(BANDS + 1)))).alias("step")).select("tile", (F.col("tile") + F.col("step")).alias("tile2"))
    near = near.join(F.broadcast(tiles.select(F.col("tile").alias("tile2"), F.col("m").alias("m2"))), "tile2")
    sent = chunks.join(near, "tile").withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("m2") - 1))).where("tile <> tile2 or chunk <= chunk2")
    theirs = chunks.select(F.col("tile").alias("tile2"), F.col("chunk").alias("chunk2"), F.col("own").alias("theirs"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = sent.join(theirs, ["tile2", "chunk2"]).where(F.greatest(F.col("low") - F.col("high2"), F.col("low2") - F.col("high")) <= RADIUS_FEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Proposals()
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = ([c.to_numpy() for c in batch.column(s).slice(k, 1).flatten().flatten()] for s in range(2))
                compare_tiles(x, y, found)
        a, b, _ = found.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.select("own", "theirs").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the texts with hash t in `wanted` (t, node), one per node."""
    bounded_batches(docs.sparkSession)
    small = wanted.count() <= SENT
    own = docs.select(F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(wanted) if small else wanted, "t").dropDuplicates(["node"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, SHINGLE)).view(np.int64) for x in utf8_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return written(rows.mapInArrow(run, "node long, shingles array<long>"), "sets")


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (node, doc_id, t), the row with the least id of each shingle set, and (node, root) of all sets with a near copy."""
    rows = written(printed(docs), "printed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("row")
    nodes = written(rows.groupBy("node").agg(first, F.first("n").alias("n"), *(F.first(b).alias(b) for b in BITS)), "nodes")
    least = nodes.select("node", "row.doc_id", "row.t")
    clusters = written(components(proposals(nodes)), "clusters")
    sets = shingle_sets(docs, written(least.join(clusters, "node").select("t", "node"), "wanted"))
    return least, components(similar_within(clusters, sets))


def one_of_alike(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component of texts with similarity 0.8 or more the row with the least doc_id stays.

    Equal shingle sets are near copies, and so are texts without words.  Rows
    with a null doc_id can't be told apart by it and stay.  Repeated rows are
    one; an empty table gives no row; all columns come through as they were.
    """
    least, roots = near_copies(docs)
    rooted = least.join(roots, "node", "left").where("doc_id is not null").select("doc_id", "t", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("row")).select("row.doc_id", F.col("row.t").alias("_t"))
    known = docs.where("doc_id is not null").withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    # of rows that share id and text the one with the least digest of all columns, so that a task that runs again picks the same
    rows = known.join(kept, ["doc_id", "_t"], "left_semi").withColumn("_all", F.xxhash64(F.to_json(F.struct(*docs.columns))))
    first = rows.groupBy("doc_id", "_t").agg(F.min_by(F.struct(*docs.columns), "_all").alias("_row")).select("_row.*")
    return first.unionByName(docs.where("doc_id is null"))
