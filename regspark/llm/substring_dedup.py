"""Suffix-array dedup: bytes of long strings that start more than once in the corpus.

Every LENGTH-byte string (a suffix, cut at the length that matters) belongs to
one anchor: the least of the hashes of its ANCHOR-byte strings.  Equal strings
have their anchor at the same place, so suffixes are sorted in slices: up to
SLICE neighbouring suffixes of one anchor, which share a core of
LENGTH - SLICE + 1 bytes.  The core is a slice's leading token, the whole
content its second one.

1. One scan turns texts into slices.
2. Sampled splitters range-partition them by core, content and place, so that no
   token is too frequent for one bucket.  A bucket sorts by tokens, each key
   refining the ties of the one before (a multikey quicksort over columns).
   Equal neighbours repeat entirely; equal cores with different contents go on.
   The first and last tokens of neighbouring buckets are compared, which
   settles the runs that cross a boundary.
3. Of each content that shares a core with others one slice is taken apart in
   suffixes: range-partitioned by core, sorted by the tokens of the strings.
   Cores that are too frequent for that are split by a longer token: their
   suffixes, one by one, go through step 2 by core and string.
4. Repeated suffixes merge to spans per document, which are cut from the text.

Two strings are equal when two tokens of 64 bits are, those of the core and of
the whole; of 10^14 strings some pair would be confused with probability 1e-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8_bytes, written

LENGTH, ANCHOR, SLICE = 400, 64, 128
CORE = LENGTH - SLICE + 1
#: Suffixes that a scan handles at once; longer texts go in overlapping parts.
PART = 1 << 22
#: Slices with one core that are taken apart in one bucket; a core with more is split by longer tokens.
CROWD = 2048
#: Slices, or suffixes, that a bucket holds on average.
BUCKET = 400_000
TABLE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = np.uint64(24)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def string_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Per size the hashes of all strings of that many bytes, from hashes of 1, 2, 4, ... bytes."""
    steps, size, now = {1: TABLE[data]}, 1, TABLE[data]
    while 2 * size <= max(sizes):
        now = now[:-size] * power(size) + now[size:]
        size *= 2
        steps[size] = now
    out = []
    for want in sizes:
        total, at = None, 0
        n = len(data) - want + 1
        for bit in reversed(range(want.bit_length())):
            if want >> bit & 1:
                part = steps[1 << bit][at : at + n]
                total = part if total is None else total * power(1 << bit) + part
                at += 1 << bit
        out.append(mixed(total))
    return out


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` neighbouring hashes the place of the least, the leftmost of equals."""
    keys = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def slices(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(core begin, first suffix, last suffix, core token, content token) per slice, part by part."""
    from xxhash import xxh3_64_intdigest

    for begin in range(0, len(text) - LENGTH + 1, PART):
        part = text[begin : begin + PART + LENGTH - 1]
        data = np.frombuffer(part, np.uint8)
        grams, cores = string_hashes(data, (ANCHOR, CORE))
        anchor = anchors(grams, LENGTH - ANCHOR + 1)
        start = np.arange(len(anchor))
        step = (anchor - start) // SLICE
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(step) != 0)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(anchor)]]) - 1
        core = anchor[first] - step[first] * SLICE
        content = [xxh3_64_intdigest(part[a : b + LENGTH], c - b) for a, b, c in zip(first.tolist(), last.tolist(), core.tolist(), strict=True)]
        yield core + begin, first + begin, last + begin, cores[core].view(np.int64), content


SLICES = pa.schema([("u", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("core", pa.int64()), ("content", pa.int64()), ("n", pa.int64())])


def slice_table(docs: DataFrame) -> DataFrame:
    """All slices of the texts. One that repeats within its part is a row with n > 1 and rows without tokens, merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in SLICES]
            for u, text in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), strict=True):
                for at, first, last, core, content in slices(text):
                    content = np.array(content, np.uint64).view(np.int64)
                    _, one, place, n = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
                    if len(one) == len(content):
                        rows = (at, first, last, core, content, np.ones_like(at))
                    else:
                        again = np.flatnonzero(n[place] > 1)
                        breaks = np.flatnonzero(first[again][1:] > last[again][:-1] + 1) + 1
                        f, t = first[again][np.concatenate([[0], breaks])], last[again][np.concatenate([breaks - 1, [-1]])]
                        none = np.full(len(f), -1)
                        rows = tuple(np.concatenate(x) for x in zip((at[one], first[one], last[one], core[one], content[one], n), (none, f, t, none, none, none), strict=True))
                    for column, x in zip(out, (np.full(len(rows[0]), u), *rows), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], schema=SLICES)

    return docs.select("u", "text").mapInArrow(run, "u long, at long, first long, last long, core long, content long, n long")


def ends_of(texts: DataFrame) -> DataFrame:
    """For slices listed with their text: the bytes before and after the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for u, text, wanted in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for s in wanted:
                    at, first, last = s["at"], s["first"], s["last"]
                    row = (u, at, at - last, at - first, s["core"], text[first:at], text[at + CORE : last + LENGTH])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["u", "at", "least", "most", "core", "before", "after"])

    return texts.select("u", "text", "wanted").mapInArrow(run, "u long, at long, least long, most long, core long, before binary, after binary")


def end_tokens(column: pa.Array, nearest_last: bool) -> np.ndarray:
    """Row i, column t: the token of the t bytes that stand nearest to the core."""
    n = len(column)
    data, sizes = np.frombuffer(b"".join(column.to_pylist()), np.uint8), np.array([len(x) for x in column.to_pylist()], np.int64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((n, SLICE), np.uint64)
    for t in range(1, SLICE):
        has = np.flatnonzero(sizes >= t)
        place = begin[has] + (sizes[has] - t if nearest_last else t - 1)
        out[has, t] = out[has, t - 1] * BASE + TABLE[data[place]]
    return out


def suffix_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bytes before the core, token of both ends) of every suffix of the slices of a batch."""
    before, after = end_tokens(batch.column("before"), True), end_tokens(batch.column("after"), False)
    least, most = (batch.column(x).to_numpy() for x in ("least", "most"))
    row = np.repeat(np.arange(batch.num_rows), most - least + 1)
    t = np.arange(len(row)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1) + least[row]
    return row, t, mixed(mixed(before[row, t]) ^ after[row, SLICE - 1 - t] * BASE)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Rows in the order of several keys: quicksort by the first, then each range of equals by the next key alone."""
    order = np.argsort(keys[0])
    for k in range(1, len(keys)):
        tied = np.concatenate([[False], np.all([x[order][1:] == x[order][:-1] for x in keys[:k]], axis=0)]) if len(order) else np.zeros(0, bool)
        inside = tied | np.concatenate([tied[1:], [False]])[: len(tied)]
        place = np.flatnonzero(inside)
        group = np.cumsum(~tied)[place]
        order[place] = order[place][np.lexsort((keys[k][order[place]], group))]
    return order


def equal_neighbours(keys: list[np.ndarray]) -> np.ndarray:
    """Which rows have an equal in all keys."""
    order = multikey_order(keys)
    equal = np.all([x[order][1:] == x[order][:-1] for x in keys], axis=0) if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order[1:][equal]] = out[order[:-1][equal]] = True
    return out


RANKED = pa.schema(
    [(x, pa.int64()) for x in ("u", "at", "first", "last", "core", "content")] + [("bucket", pa.int32())] + [(x, pa.bool_()) for x in ("same", "lead", "varied")] + [("edge", pa.list_(pa.int64()))]
)


def settled_bucket(rows: pa.Table, bucket: int) -> pa.RecordBatch:
    """The rows of a bucket that repeat or share their core, and those of its first and last core; then one row of edges.

    same: another row has this core and content; lead: the first of such rows;
    varied: the core has other contents.  Edges: first core, its least and
    greatest content, last core, its least and greatest content.
    """
    column = {x: rows.column(x).to_numpy() for x in ("u", "at", "first", "last", "core", "content", "n")}
    order = multikey_order([column["core"], column["content"]])
    column = {x: v[order] for x, v in column.items()}
    core, content = column["core"], column["content"]
    new_core = np.concatenate([[True], core[1:] != core[:-1]])
    lead = new_core | np.concatenate([[True], content[1:] != content[:-1]])
    group, run = np.cumsum(lead) - 1, np.cumsum(new_core) - 1
    same = (np.bincount(group)[group] > 1) | (column["n"] > 1)
    varied = np.bincount(run[lead])[run] > 1
    head, tail = run == 0, run == run[-1]
    keep = np.flatnonzero(same | varied | head | tail)
    edge = [core[0], content[0], content[head][-1], core[-1], content[tail][0], content[-1]]
    out = [pa.array(np.append(column[x][keep], 0)) for x in ("u", "at", "first", "last", "core", "content")]
    out += [pa.array(np.full(len(keep) + 1, bucket, np.int32)), *(pa.array(np.append(x[keep], False)) for x in (same, lead, varied))]
    out.append(pa.array([None] * len(keep) + [list(map(int, edge))], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(out, schema=RANKED)


def boundary_rows(edges: list[tuple[int, list[int]]]) -> list[tuple]:
    """Per bucket, in their order: bucket, first core and content, last core and content, and what the neighbours tell of both."""
    edges = sorted(edges)
    reach: dict[int, tuple[int, int]] = {}
    for _, (c, low, high, d, low2, high2) in edges:
        for x, a, b in ((c, low, high), (d, low2, high2)):
            known = reach.get(x, (a, b))
            reach[x] = min(a, known[0]), max(b, known[1])
    crosses = [False, *((x[3], x[5]) == (y[0], y[1]) for (_, x), (_, y) in zip(edges, edges[1:], strict=False)), False]
    return [
        (bucket, e[0], e[1], e[3], e[5], crosses[k], crosses[k + 1], reach[e[0]][0] != reach[e[0]][1], reach[e[3]][0] != reach[e[3]][1])
        for k, (bucket, e) in enumerate(edges)
    ]


def ranked(rows: DataFrame) -> DataFrame:
    """Slices (u, at, first, last, core, content, n) of a written table that repeat (same) or share their core (varied).

    A bucket's edges are one row each, so what the driver sees is bounded by
    the number of buckets.
    """
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [x for x in batches if x.num_rows]
        if held:
            yield settled_bucket(pa.Table.from_batches(held), TaskContext.get().partitionId())

    kinds = "u long, at long, first long, last long, core long, content long, bucket int, same boolean, lead boolean, varied boolean, edge array<long>"
    sorted_ = written(rows.repartitionByRange(buckets, "core", "content", "u", "at").mapInArrow(run, kinds), "ranked")
    edges = [(r.bucket, r.edge) for r in sorted_.where("edge is not null").select("bucket", "edge").collect()]
    names = "bucket int, core_a long, content_a long, core_z long, content_z long, same_a boolean, same_z boolean, varied_a boolean, varied_z boolean"
    known = spark.createDataFrame(boundary_rows(edges), names)
    first, last = "core = core_a and content = content_a", "core = core_z and content = content_z"
    return sorted_.where("edge is null").join(F.broadcast(known), "bucket").select(
        "u", "at", "first", "last", "core",
        F.expr(f"same or ({first} and same_a) or ({last} and same_z)").alias("same"),
        F.expr(f"lead and not ({first} and same_a)").alias("lead"),
        F.expr("varied or (core = core_a and varied_a) or (core = core_z and varied_z)").alias("varied"),
    )


def runs_out(batch: pa.RecordBatch, row: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    """Repeated suffixes as runs (u, first, last); row and t ascend."""
    u, at = batch.column("u").to_numpy(), batch.column("at").to_numpy()
    breaks = np.flatnonzero((np.diff(row) != 0) | (np.diff(t) != 1)) + 1
    low, high = np.concatenate([[0], breaks])[: len(row)].astype(np.int64), np.concatenate([breaks, [len(row)]])[: len(row)].astype(np.int64) - 1
    if not len(row):
        low = high = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(u[row[low]]), pa.array(at[row[low]] - t[high]), pa.array(at[row[low]] - t[low])], names=["u", "first", "last"])


def sorted_buckets(ends: DataFrame, buckets: int) -> DataFrame:
    """Repeated suffixes of slices whose cores fit in a bucket, as runs; a core is never in two buckets."""

    def settle(held: pa.Table) -> pa.RecordBatch:
        whole = held.combine_chunks().to_batches()[0]
        row, t, token = suffix_tokens(whole)
        twice = equal_neighbours([whole.column("core").to_numpy()[row], t, token])
        return runs_out(whole, row[twice], t[twice])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            core = held.column("core").to_numpy()
            whole = int(np.flatnonzero(core != core[-1])[-1]) + 1 if core[0] != core[-1] else 0
            if whole >= 2000:  # cores that are complete; the last may go on in the next batch
                yield settle(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield settle(held)

    return ends.repartitionByRange(buckets, "core").sortWithinPartitions("core").mapInArrow(run, "u long, first long, last long")


def single_suffixes(ends: DataFrame) -> DataFrame:
    """The suffixes of slices one by one, as slices of their own with the token of the string as content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, t, token = suffix_tokens(batch)
            u, at, core = (batch.column(x).to_numpy()[row] for x in ("u", "at", "core"))
            token = mixed(token ^ t.astype(np.uint64) * BASE).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u, at - t, at - t, at - t, core, token, np.ones_like(t))], schema=SLICES)

    return ends.mapInArrow(run, "u long, at long, first long, last long, core long, content long, n long")


def merged_spans(runs: list[dict]) -> list[tuple[int, int]]:
    """Byte spans of runs of suffixes, merged where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + LENGTH) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text (as bytes), runs (array of first and last suffix, null if none repeats)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = plain.select("*", F.xxhash64(F.col(key), "text").alias("u"))  # equal rows share a name, any other two differ
    every = written(slice_table(keyed), "slices")
    known = every.where("n < 0").select("u", "first", "last")
    shared = written(ranked(every.where("n > 0")), "shared")
    same = shared.where("same").select("u", "first", "last")
    parts = written(shared.where("varied and lead").select("u", "at", "first", "last", "core"), "parts")
    crowds = written(parts.groupBy("core").count().where(F.col("count") > CROWD).select("core"), "crowds")
    wanted = parts.groupBy("u").agg(F.collect_list(F.struct("at", "first", "last", "core")).alias("wanted"))  # bounded by the text
    ends = written(ends_of(keyed.select("u", "text").join(wanted, "u")), "ends")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() * SLICE // 4 // BUCKET))
    few, many = ends.join(crowds, "core", "left_anti"), ends.join(crowds, "core", "left_semi")
    runs = sorted_buckets(few, buckets)
    if not crowds.isEmpty():
        runs = runs.unionByName(ranked(written(single_suffixes(many), "suffixes")).where("same").select("u", "first", "last"))
    spans = known.unionByName(same).unionByName(runs).groupBy("u").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return keyed.join(spans, "u", "left").select(key, "text", "runs")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    A byte goes if a LENGTH-byte string over it starts at two places or more of
    the input, within one text or in several.  Null, empty and shorter texts
    lose nothing.  Repeated rows repeat each other.  Cuts are by bytes, so what
    is kept need not be whole characters.  Other columns are ignored; an empty
    table gives no row.
    """
    spans = repeated_spans(docs, key, text)
    kind = spans.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for whole, runs in zip(utf8_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                at, rest, cut = 0, [], merged_spans(runs or [])
                for a, b in cut:
                    rest.append(whole[at:a])
                    at = b
                rest = b"".join([*rest, whole[at:]])
                for column, x in zip(out, (len(whole), len(whole) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return spans.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
