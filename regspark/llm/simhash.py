"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles by the population counts of their
four 16-bit quarters.  Two fingerprints that differ in r bits have counts that
differ by r at most, summed over the quarters, so tile pairs further apart are
skipped and all others compared in full: numpy exclusive-or and bit counts.
Crowded tiles are cut in chunks, so that every pair of chunks is a bounded
task of its own.  What a task finds leaves it as stars, not as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8_bytes, written
from .components import components

SHINGLE = 3
RADIUS = 3
#: Fingerprints in a chunk: at least, and at most (in crowded tiles).
CHUNK = (4096, 32768)
PAIRS_AT_ONCE = 1 << 20


def shingle_hashes(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """XXH64 with seed 42 of every run of `words` words, A-Z in lower case, joined by spaces."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    begins = [0, *ends[: len(found) - words].tolist()]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and its fingerprint as a signed long (null and empty texts: 0)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[key], docs[text].cast("string"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(shingle_hashes(x, words)) for x in utf8_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=[key, "bits"])

    return source.mapInArrow(run, f"`{key}` {kind}, bits long")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b), as links of every node to its least."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[x], root[y])
        for side in (x, y):
            np.minimum.at(root, side, least)
            np.minimum.at(root, before[side], least)
        root = root[root]
        if np.array_equal(root, before):
            off = root != np.arange(len(nodes))
            return nodes[off], nodes[root[off]]


class Links:
    """Links found so far, kept as stars."""

    def __init__(self):
        self.a, self.b, self.size = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
        if self.size > 4 * PAIRS_AT_ONCE:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = stars(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.size = [a], [b], len(a)
        return a, b


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, as numpy counts the bits of absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def compare_large(x: np.ndarray, y: np.ndarray, radius: int, links: Links) -> None:
    step = max(1, PAIRS_AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), step):
        i, j = np.nonzero(distance(x[at : at + step, None], y[None, :]) <= radius)
        links.add(x[at + i], y[j])


def compare_batch(left: pa.ListArray, right: pa.ListArray, radius: int, links: Links) -> None:
    """All pairs of each row's two lists: large rows one by one, small ones together."""
    x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (left, right))
    nx, ny = (np.asarray(c.value_lengths(), np.int64) for c in (left, right))
    bx, by = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    pairs = nx * ny
    for r in np.flatnonzero(pairs > 1 << 15):
        compare_large(x[bx[r] : bx[r] + nx[r]], y[by[r] : by[r] + ny[r]], radius, links)
    rows = np.flatnonzero((pairs > 0) & (pairs <= 1 << 15))
    for group in np.split(rows, np.flatnonzero(np.diff(np.cumsum(pairs[rows]) // PAIRS_AT_ONCE)) + 1) if len(rows) else ():
        row = np.repeat(group, pairs[group])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pairs[group]) - pairs[group], pairs[group])
        i, j = np.divmod(nth, ny[row])
        a, b = x[bx[row] + i], y[by[row] + j]
        near = distance(a, b) <= radius
        links.add(a[near], b[near])


def tile_of(bits: str, shift: int = 0):
    """Population counts of the quarters, one byte each."""
    counts = [F.bit_count(F.shiftrightunsigned(F.col(bits), 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    return sum((c * (1 << (8 * q)) for q, c in enumerate(counts)), F.lit(0)).cast("int")


def near_tiles(radius: int) -> list[int]:
    """Offsets to every tile within the radius, one of each pair of opposite ones."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [sum(x << (8 * q) for q, x in enumerate(d)) for d in steps if d >= (0, 0, 0, 0)]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within the radius; `prints` has distinct `bits`.

    Tiles number at most 17**4, which bounds the table that is broadcast.
    A quarter count is 0 to 16, so adding an offset to a tile's bytes gives a
    tile that exists or none: a byte that under- or overflows holds 17 or more.
    """
    spark = prints.sparkSession
    bounded_batches(spark)
    tiled = prints.select("bits", tile_of("bits").alias("tile"))
    size = F.greatest(F.lit(CHUNK[0]), F.least(F.lit(CHUNK[1]), (32 * F.sqrt(F.col("count"))).cast("int")))
    tiles = written(tiled.groupBy("tile").count().select("tile", F.ceil(F.col("count") / size).cast("int").alias("n")), "tiles")
    chunk = F.pmod(F.xxhash64("bits"), F.col("n")).cast("int")
    chunks = written(tiled.join(F.broadcast(tiles), "tile").groupBy("tile", chunk.alias("chunk")).agg(F.collect_list("bits").alias("own")), "chunks")
    other = tiles.select(F.col("tile").alias("tile2"), F.col("n").alias("n2"))
    # the neighbours of a tile are found before its chunks carry their fingerprints there
    near = tiles.select("tile", F.explode(F.array(*(F.lit(d) for d in near_tiles(radius)))).alias("step")).select("tile", (F.col("tile") + F.col("step")).alias("tile2"))
    near = near.join(F.broadcast(other), "tile2")
    sent = chunks.join(near, "tile").withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1))).where("tile <> tile2 or chunk <= chunk2")
    pairs = sent.select("tile2", "chunk2", "own").join(chunks.select(F.col("tile").alias("tile2"), F.col("chunk").alias("chunk2"), F.col("own").alias("theirs")), ["tile2", "chunk2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for batch in batches:
            compare_batch(batch.column(0), batch.column(1), radius, links)
        a, b = links.shrink()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("own", "theirs").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id (the least key reachable over links).

    Texts without words (null, empty, white space) have fingerprint zero and
    link like any other.  Repeated rows each give a row; a null key takes part
    but is never a component's id; other columns are ignored; an empty table
    gives no row.
    """
    prints = written(fingerprints(docs, words, key, text), "prints")
    distinct = written(prints.groupBy("bits").agg(F.min(key).alias("least")), "distinct")
    roots = components(near_links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(named, "root").select("bits", "component_id"), "classes")
    return prints.join(classes, "bits").select(key, F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the row with the least doc_id stays.

    Rows with a null doc_id can't be told apart by it and stay.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return first.unionByName(docs.where("doc_id is null"))
