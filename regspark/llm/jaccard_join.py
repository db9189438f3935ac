"""N-gram Jaccard self-join by PartEnum signatures: exact links of documents whose shingle sets have similarity 0.8 or more.

Sets meet in overlapping bands of sizes, such that any two similar sets share a
band.  A band splits the domain of shingles in parts, and a signature is a part
with what a set has there.  Similar sets of sizes a <= b differ in (a + b) / 9
shingles at most, each of which spoils one part, so all other parts give both
sets the same signature: of its non-empty parts a set shares `need` or more
with each similar one.  Parts are as many as make that number positive by far,
so subsets of one size are enumerated: single parts (sets below FEW shingles
have a part for each shingle).

That number is used three times.  A set that shares fewer signatures than it
needs with all others together has no partner, and leaves before anything but
numbers was moved.  Of the others, each drops its `need` - 1 most frequent
shared signatures, as two similar sets also share a rarer one; so passages
that many documents quote connect nobody.  What is left connects sets to
clusters, and the sets of a cluster are compared exactly.

Signatures travel packed: a row holds what one batch has for one bucket.
A signature that several sets of a batch have is sent once for them all, so a
signature of a third of all sets costs its bucket one entry for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, utf8_bytes, written
from .components import components
from .near_copies import shingle_sets
from .set_links import similar_within
from .simhash import shingle_hashes

SHINGLE = 5
#: Sets below FEW shingles have a part for each shingle. Bands begin a factor STEP apart; parts per shingle of the largest set that differs, times PARTS.
FEW, STEP, PARTS = 64, 1.56, 1.5
#: Nodes that are dealt together when frequencies are counted.
NODES = 1000
ENTRY = np.dtype([("sig", "<u4"), ("owner", "<i8")])
COUNTED = np.dtype([("sig", "<u8"), ("n", "<i8")])
HELD = np.dtype([("sig", "<u8"), ("node", "<i8")])


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 bits that depend on all bits of x, another way for each salt."""
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def band_edges(largest: int) -> np.ndarray:
    """The least sizes of the bands from FEW on, one beyond `largest`."""
    edges = [FEW]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * STEP)))
    return np.array([*edges, int(edges[-1] * STEP)], np.int64)


def last_size(next_edge: np.ndarray) -> np.ndarray:
    """The largest set of a band: it has every set that is similar to one below the next band's edge."""
    return (5 * next_edge + 3) // 4


def spread(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def signatures(shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sets that lie one after the other: (set, band, need) for each band that a set is in, and (signature, place in these).

    Sets of fewer than four shingles are in no band, as no other set is similar to them.
    """
    begin = np.cumsum(sizes) - sizes
    edges = band_edges(int(sizes.max(initial=0)))
    home = np.searchsorted(edges, sizes, "right")  # 0: the band of small sets
    lower = np.where(home > 0, sizes <= last_size(edges[np.maximum(home, 1) - 1]), False)
    usable = sizes >= 4
    first, second = np.flatnonzero(usable), np.flatnonzero(usable & lower)
    sets = np.concatenate([first, second])
    bands = np.concatenate([home[first], home[second] - 1])
    a = sizes[sets]
    last = last_size(edges[bands])
    owner = np.repeat(np.arange(len(sets)), a)
    x = shingles[np.repeat(begin[sets], a) + spread(a)]
    small = bands[owner] == 0
    parts = np.where(bands > 0, np.ceil(PARTS * last / 4).astype(np.int64) + 1, 0)
    at = np.cumsum(parts) - parts
    big = owner[~small]
    part = at[big] + ((mixed(x[~small], 1) >> np.uint64(32)).astype(np.int64) * parts[big] >> 32)
    total = np.zeros(int(parts.sum()), np.uint64)
    np.add.at(total, part, mixed(x[~small], 2))
    filled = np.bincount(part, minlength=len(total)) > 0
    holder = np.repeat(np.arange(len(sets)), parts)
    differ = np.minimum(a // 4, (a + last) // 9)
    need = np.where(bands > 0, np.bincount(holder[filled], minlength=len(sets)) - differ, (4 * a + 4) // 5)
    send = filled | (need <= 0)[holder]  # where non-empty parts may all differ, empty ones count too
    named = mixed(mixed(total[send], 3) + (spread(parts)[send].astype(np.uint64) << np.uint64(8)) + bands[holder[send]].astype(np.uint64), 4)
    return sets, bands, np.maximum(need, 0), np.concatenate([mixed(x[small], 5), named]), np.concatenate([owner[small], holder[send]])


def packed(bucket: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, its entries as bytes)."""
    order, begins, size = alike(bucket)
    bucket, entries = bucket[order], entries[order]
    for a, n in zip(begins.tolist(), size.tolist(), strict=True):
        yield int(bucket[a]), entries[a : a + n].tobytes()


def alike(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the signatures, where its groups begin, and how many each has."""
    order = np.argsort(sig, kind="stable")
    new = np.ones(len(sig), bool)
    new[1:] = sig[order][1:] != sig[order][:-1]
    begins = np.flatnonzero(new)
    return order, begins, np.diff(np.append(begins, len(sig)))


def buckets_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


MARKS = ("doc_id", "t", "node", "n", "owner", "need", "shared", "bucket", "blob")


def marks(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Documents: doc_id, t (hash of the text), node (hash of the set), n.
    Sets: owner (a hash of node and band), node, need, and parts of the number of `shared` signatures, which count for every row of the owner.

    Exact copies that meet in different batches may be counted repeatedly, so the
    sum is that number or more.  So it is where signatures collide.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    count = buckets_of(spark)
    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))
    kind = source.schema[0].dataType.simpleString()
    own = [pa.int64()] * 6 + [pa.int32(), pa.binary()]

    def rows(type_: pa.DataType, length: int, **columns) -> pa.RecordBatch:
        as_array = lambda x, k: x if isinstance(x, pa.Array) else pa.array(x, k)
        return pa.RecordBatch.from_arrays([as_array(columns[c], k) if c in columns else pa.nulls(length, k) for c, k in zip(MARKS, [type_, *own], strict=True)], names=list(MARKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [np.unique(shingle_hashes(x, SHINGLE)) for x in utf8_bytes(batch.column(2))]
            nodes = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            sizes = np.array([len(s) for s in sets], np.int64)
            spot = (nodes.view(np.uint64) % np.uint64(count)).astype(np.int32)
            yield rows(batch.column(0).type, len(sets), doc_id=batch.column(0), t=batch.column(1), node=nodes, n=sizes, bucket=spot)
            nodes, one = np.unique(nodes, return_index=True)
            sizes = sizes[one]
            which, bands, need, sig, at = signatures(np.concatenate([sets[i] for i in one]) if len(one) else np.zeros(0, np.uint64), sizes)
            owner = mixed(nodes[which].view(np.uint64) + bands.astype(np.uint64), 6).view(np.int64)
            order, begins, size = alike(sig)
            here = np.zeros(len(which), np.int64)
            met = np.repeat(size > 1, size)
            np.add.at(here, at[order][met], 1)
            yield rows(batch.column(0).type, len(which), node=nodes[which], owner=owner, need=need, shared=here, bucket=(owner.view(np.uint64) % np.uint64(count)).astype(np.int32))
            sent = order[begins]
            entries = np.zeros(len(sent), ENTRY)
            entries["sig"] = sig[sent] & np.uint64(0xFFFFFFFF)
            entries["owner"] = np.where(size > 1, 0, owner[at[sent]])  # 0: shared, and counted already
            blobs = list(packed((sig[sent] >> np.uint64(32)).astype(np.int64) % count, entries))
            yield rows(batch.column(0).type, len(blobs), bucket=[b for b, _ in blobs], blob=[x for _, x in blobs])

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, buckets, type_ = [], [], None
        for batch in batches:
            type_ = batch.column(0).type
            is_blob = batch.column(8).is_valid()
            yield batch.filter(pa.array(~np.asarray(is_blob)))
            for b, x in zip(batch.column(7).filter(is_blob).to_pylist(), batch.column(8).filter(is_blob).to_pylist(), strict=True):
                held.append(np.frombuffer(x, ENTRY))
                buckets.append(np.full(len(held[-1]), b, np.uint64))
        if held:
            entries = np.concatenate(held)
            order, begins, size = alike((np.concatenate(buckets) << np.uint64(32)) + entries["sig"])
            owner = entries["owner"][order]
            other = np.zeros(len(owner), bool)
            other[1:] = owner[1:] != owner[:-1]
            other[begins] = False
            shared = owner[np.repeat(np.logical_or.reduceat(other, begins), size)]  # not those of exact copies alone
            owner, n = np.unique(shared[shared != 0], return_counts=True)
            yield rows(type_, len(owner), owner=owner, shared=n)

    schema = f"doc_id {kind}, t long, node long, n long, owner long, need long, shared long, bucket int, blob binary"
    dealt = source.mapInArrow(cut, schema).repartition(count, "bucket")
    return written(dealt.mapInArrow(count_up, schema).drop("bucket", "blob"), "marks")


def wanted_sets(found: DataFrame) -> DataFrame:
    """Nodes that share as many signatures with others, in one of their bands, as they do with any similar set."""
    owners = found.where("owner is not null").groupBy("owner").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"), F.max("node").alias("node"))
    return owners.where("need is not null and shared >= need").select("node").distinct()


def proposals(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets (node, shingles) with a rare signature in common."""
    spark = sets.sparkSession
    bounded_batches(spark)
    count = buckets_of(spark)
    groups = max(1, -(-sets.count() // NODES))
    dealt = written(sets.withColumn("batch", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")), "dealt")

    def own(table: pa.Table) -> tuple[np.ndarray, ...]:
        lists = table.column("shingles").combine_chunks()
        nodes = table.column("node").to_numpy()
        which, bands, need, sig, at = signatures(lists.flatten().to_numpy().view(np.uint64), np.asarray(lists.value_lengths(), np.int64))
        return nodes[which], need, sig, at

    def counts(table: pa.Table) -> pa.Table:
        sig, n = np.unique(own(table)[2], return_counts=True)
        entries = np.zeros(len(sig), COUNTED)
        entries["sig"], entries["n"] = sig, n
        blobs = list(packed((sig >> np.uint64(32)).astype(np.int64) % count, entries))
        batch = table.column("batch")[0].as_py() if table.num_rows else 0
        return pa.table({"batch": pa.array([batch] * len(blobs), pa.int32()), "bucket": pa.array([b for b, _ in blobs], pa.int32()), "blob": pa.array([x for _, x in blobs], pa.binary())})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, senders = [], []
        for batch in batches:
            for sender, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(np.frombuffer(x, COUNTED))
                senders.append(np.full(len(held[-1]), sender, np.int64))
        if held:
            entries, sender = np.concatenate(held), np.concatenate(senders)
            order, begins, size = alike(entries["sig"])
            total = np.repeat(np.add.reduceat(entries["n"][order], begins), size)
            again = total > 1
            entries, sender = entries[order][again], sender[order][again]
            entries["n"] = total[again]
            blobs = list(packed(sender, entries))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["batch", "blob"])

    def rare(mine: pa.Table, told: pa.Table) -> pa.Table:
        out = {"a": [], "b": [], "bucket": [], "blob": []}
        if mine.num_rows and told.num_rows:
            node, need, sig, at = own(mine)
            known = np.sort(np.concatenate([np.frombuffer(x, COUNTED) for x in told.column("blob").to_pylist()]), order="sig")
            spot = np.minimum(np.searchsorted(known["sig"], sig), len(known) - 1)
            shared = known["sig"][spot] == sig
            sig, at, often = sig[shared], at[shared], known["n"][spot[shared]]
            order = np.lexsort((sig, often, at))
            sig, at = sig[order], at[order]
            has = np.bincount(at, minlength=len(node))
            keep = spread(has) <= (has - np.maximum(need, 1))[at]  # none of a set that shares too few
            sig, at = sig[keep], at[keep]
            order, begins, size = alike(sig)
            holder = node[at][order]
            least = np.repeat(np.minimum.reduceat(holder, begins), size) if len(begins) else holder
            links = np.unique(np.stack([holder, least], axis=1)[holder != least], axis=0)
            entries = np.zeros(len(begins), HELD)
            entries["sig"], entries["node"] = sig[order][begins], least[begins]
            blobs = list(packed((entries["sig"] >> np.uint64(32)).astype(np.int64) % count, entries))
            out = {"a": [*links[:, 0].tolist(), *[None] * len(blobs)], "b": [*links[:, 1].tolist(), *[None] * len(blobs)], "bucket": [*(links[:, 0] % count).tolist(), *(b for b, _ in blobs)], "blob": [*[None] * len(links), *(x for _, x in blobs)]}
        return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            links = batch.filter(batch.column(0).is_valid())
            yield pa.RecordBatch.from_arrays([links.column(0), links.column(1)], names=["a", "b"])
            held += [np.frombuffer(x, HELD) for x in batch.column(3).drop_null().to_pylist()]
        if held:
            entries = np.concatenate(held)
            order, begins, size = alike(entries["sig"])
            holder = entries["node"][order]
            least = np.repeat(np.minimum.reduceat(holder, begins), size)
            links = np.unique(np.stack([holder, least], axis=1)[holder != least], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    sent = dealt.groupBy("batch").applyInArrow(counts, "batch int, bucket int, blob binary").repartition(count, "bucket")
    told = sent.mapInArrow(frequencies, "batch int, blob binary")
    kept = dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(rare, "a long, b long, bucket int, blob binary")
    return kept.repartition(count, "bucket").mapInArrow(meet, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included).

    Texts without words, null ones too, have an empty set and are linked with
    nothing; equal sets are linked.  Repeated rows each give a row; rows with a
    null doc_id take part, but no component is named after them unless it has
    no other row; other columns are ignored; an empty table gives no row.
    """
    found = marks(docs)
    rows = found.where("owner is null").select("doc_id", "t", "node", "n")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("t").alias("t"))
    wanted = written(nodes.join(wanted_sets(found), "node", "left_semi").select("t", "node"), "wanted")
    sets = shingle_sets(docs, wanted)
    roots = components(similar_within(written(components(proposals(sets)), "clusters"), sets))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(rooted.join(named, "root").select("node", "component_id"), "classes")
    linked = rows.where("n > 0").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
