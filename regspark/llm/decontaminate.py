"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task.  Its words become ids (1, 2, ... for
words of the benchmark, 0 for a gap of other words or a document's end).  The
shard's suffix array gives its Burrows-Wheeler transform, a wavelet tree of
bit planes answers ranks, backward search finds all test phrases at once, and
sampled suffix positions locate their occurrences.  Overlapping occurrences
merge into removal spans.

The benchmark is the query set: it goes to the tasks as text, in blocks of
bounded size against all documents, and one block is on the driver at a time.
A shard has one index, which all windows of a block are searched in, in parts of
bounded size.  A benchmark beyond one block is one more pass for each, whose
results are merged by a number of the row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, empty_if_null, utf8_bytes, worker_cache, written

WINDOW = 10
SHARD_SYMBOLS = 1 << 19
#: Benchmark text of one pass, sent to all tasks; a worker's tables of it take about five times as much.
BLOCK_BYTES = 32 << 20
#: Windows that are searched at once.
SEARCHED = 1 << 18
#: Names of items in a batch of results.
LISTED = 1 << 18
#: The row number that identifies a document between blocks.
ROW = "_row"
#: Lower case for A-Z; a space for every ASCII byte that is no letter or digit; other bytes as they are.
FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling: ranks of 1, 2, 4, ... symbols until all differ."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(symbols[order]) != 0)])
    step = 1
    while rank[order[-1]] < n - 1:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        step *= 2
    return order


class WaveletTree:
    """Ranks of a symbol in a prefix: one bit plane per bit, zeros before ones (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        begin = np.zeros_like(end)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            high = (symbol >> level) & 1 == 1
            begin = np.where(high, zeros + ones[begin], begin - ones[begin])
            end = np.where(high, zeros + ones[end], end - ones[end])
        return end - begin


class FMIndex:
    """Backward search and location over a sequence of symbols; symbol 0 separates and is in no phrase."""

    SAMPLE = 16

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols + 1, 0)  # an end that sorts before all else and stands once
        order = suffix_array(symbols)
        self.last = symbols[order - 1]
        self.tree = WaveletTree(self.last)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.sampled = order % self.SAMPLE == 0
        self.positions = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1
        self.n, self.top = len(symbols), len(self.before) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row ranges of all phrases; a phrase stands at the right end of its row, zeros before it."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            go = np.flatnonzero((lengths >= back) & (low < high))
            c = phrases[go, -back] + 1
            known = c < self.top
            low[go[~known]] = high[go[~known]] = 0
            go, c = go[known], c[known]
            low[go], high[go] = self.before[c] + self.tree.rank(c, low[go]), self.before[c] + self.tree.rank(c, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled suffix is met."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.sampled[at]
            found[open_[hit]] = self.positions[self.nth[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            c = self.last[at]
            rows[open_] = self.before[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return found


def named(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers for the runs of k ids that begin at each place (where one ends in time); equal runs have equal numbers."""
    names, have = ids.astype(np.int64), 1
    while have < k:
        step = min(have, k - have)
        key = names[:-step] * (int(names.max(initial=0)) + 1) + names[step:]
        names, have = np.unique(key, return_inverse=True)[1], have + step
    return names


class Phrases:
    """The different windows of a block of test items, as runs of word ids, and the items that each stands in.

    A window that many items share is searched and located once; items come in
    where spans are merged already, each once for a document.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        items = sorted(items)
        number = self.vocabulary.setdefault
        ids = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        sizes = np.array([len(x) for x in ids], np.int64)
        names = list(dict.fromkeys(item for item, _ in items))  # sorted, repeated items once
        self.names, number_of = pa.array(names, pa.string()), {item: k for k, item in enumerate(names)}
        self.ids = np.concatenate([np.zeros(window, np.int32), *ids])  # room before the first, for windows that are short
        times = np.maximum(sizes - window + 1, np.minimum(sizes, 1))
        row = np.repeat(np.arange(len(items)), times)
        item = np.array([number_of[item] for item, _ in items], np.int64)[row]
        begin = np.cumsum(sizes) - sizes + window
        start = np.repeat(begin, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        length = np.minimum(sizes, window)[row]
        # windows by (length, name); the first of each is searched, and `owner` lists all their items
        name = np.zeros(len(item), np.int64)
        for k in np.unique(length):
            own = length == k
            name[own] = named(self.ids, int(k))[start[own]]
        order = np.lexsort((item, name, length))
        new = np.ones(len(order), bool)
        new[1:] = (length[order][1:] != length[order][:-1]) | (name[order][1:] != name[order][:-1])
        self.start, self.length = start[order][new], length[order][new]
        self.owner, self.owners = item[order], np.append(np.flatnonzero(new), len(order))

    def windows(self, which: slice) -> np.ndarray:
        """Windows at the right end of their rows, zeros before them."""
        back = np.arange(-self.window, 0)
        length = self.length[which]
        rows = self.ids[(self.start[which] + length)[:, None] + back[None, :]].astype(np.int64)
        rows[back[None, :] < -length[:, None]] = 0
        return rows

    def items_of(self, phrases: np.ndarray) -> np.ndarray:
        """The items of different windows, each once, by name."""
        begin, size = self.owners[phrases], self.owners[phrases + 1] - self.owners[phrases]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        return np.unique(self.owner[place])

    def scan(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
        """Per document the merged [begin, end) spans of hit words, and the windows that occur (for `items_of`)."""
        nothing = np.zeros(0, np.int64)
        out: list[tuple[list[tuple[int, int]], np.ndarray]] = [([], nothing) for _ in documents]
        symbols, origin, begins, total = [], [], [], 0
        for words in documents:
            ids = np.fromiter(map(lambda w, get=self.vocabulary.get: get(w, 0), words), np.int64, len(words))
            keep = np.flatnonzero((ids > 0) | np.concatenate([[True], ids[:-1] > 0])[: len(ids)])  # a run of gaps is one gap
            begins.append(total)
            symbols += [ids[keep], np.zeros(1, np.int64)]
            origin += [keep, np.full(1, len(ids))]
            total += len(keep) + 1
        if not total or not len(self.start):
            return out
        text, word_at = np.concatenate(symbols), np.concatenate(origin)
        index = FMIndex(text)
        found, rows = [], []
        for at in range(0, len(self.start), SEARCHED):
            part = slice(at, at + SEARCHED)
            low, high = index.search(self.windows(part), self.length[part])
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            found.append(at + np.repeat(hit, times))
            rows.append(np.repeat(low[hit] - np.concatenate([[0], np.cumsum(times)])[:-1], times) + np.arange(times.sum()))
        phrase = np.concatenate(found)
        if not len(phrase):
            return out
        place = index.locate(np.concatenate(rows))
        document = np.searchsorted(np.array(begins), place, side="right") - 1
        order = np.lexsort((place, document))
        document, phrase = document[order], phrase[order]
        begin = word_at[place[order]]
        # spans of all documents on one line, a document's words far from the next one's
        far = int(word_at.max()) + self.window + 1
        reach = np.maximum.accumulate(document * far + begin + self.length[phrase])
        first = np.flatnonzero(np.concatenate([[True], (document * far + begin)[1:] > reach[:-1]]))
        last = np.append(first[1:], len(begin)) - 1
        cut = np.searchsorted(document[first], np.arange(len(documents) + 1))
        spans = np.stack([begin[first], reach[last] - document[first] * far], axis=1)
        edge = np.searchsorted(document, np.arange(len(documents) + 1))
        for d in np.unique(document).tolist():
            out[d] = [tuple(s) for s in spans[cut[d] : cut[d + 1]].tolist()], np.unique(phrase[edge[d] : edge[d + 1]])
        return out


class Block:
    """A block of test items for tasks: the text is sent once to each machine, its windows are made once in each worker."""

    def __init__(self, spark: SparkSession, items: list[tuple[str, bytes]], window: int):
        self.sent, self.window, self.name = spark.sparkContext.broadcast(items), window, f"phrases_{uuid.uuid4().hex}"

    def phrases(self) -> Phrases:
        held = worker_cache("phrases", dict)
        if self.name not in held:
            held.clear()  # those of an earlier pass
            held[self.name] = Phrases(self.sent.value, self.window)
        return held[self.name]


def shards(batches: Iterator[pa.RecordBatch], symbols: int = SHARD_SYMBOLS) -> Iterator[tuple[list, list[bytes], list[list[bytes]]]]:
    """Runs of (keys, texts, words) with about `symbols` words each."""
    keys, texts, words, held, kind = [], [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for k, x in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), strict=True):
            keys.append(k)
            texts.append(x)
            words.append(words_of(x))
            held += len(words[-1])
            if held >= symbols:
                yield pa.array(keys, kind), texts, words
                keys, texts, words, held = [], [], [], 0
    if keys:
        yield pa.array(keys, kind), texts, words


def query_blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in blocks of about `most` bytes; only one block is on the driver at a time."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), empty_if_null(text).alias("text")).where("item is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item, r.text.encode()) for r in block.toLocalIterator()]


def block_scan(rows: DataFrame, key: str, text: str, block: Block) -> DataFrame:
    """key, n_words, spans and items of every row, for one block of the benchmark."""
    bounded_batches(rows.sparkSession)
    source = rows.select(rows[key], rows[text].cast("string"))
    kind = source.schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.phrases()
        for keys, _, words in shards(batches):
            got = phrases.scan(words)
            at = 0
            while at < len(got):
                end, items, held = at, [], 0
                while end < len(got) and held < LISTED:  # rows leave before their lists of items fill a worker
                    items.append(phrases.items_of(got[end][1]))
                    held += len(items[-1])
                    end += 1
                edges = pa.array(np.cumsum([0, *map(len, items)]), pa.int32())
                lists = pa.ListArray.from_arrays(edges, phrases.names.take(pa.array(np.concatenate(items))))
                spans = pa.array([[{"begin": a, "end": b} for a, b in s] for s, _ in got[at:end]], span)
                yield pa.RecordBatch.from_arrays([keys.slice(at, end - at), pa.array(map(len, words[at:end]), pa.int64()), spans, lists], names=[key, "n_words", "spans", "items"])
                at = end

    return source.mapInArrow(run, f"`{key}` {kind}, n_words long, spans array<struct<begin:long,end:long>>, items array<string>")


def pass_by_pass(rows: DataFrame, key: str, text: str, first: list[tuple[str, bytes]], blocks: Iterator[list[tuple[str, bytes]]], window: int) -> DataFrame:
    """What all blocks find, one row per row; a block's result is written before the next one is read."""
    spark, parts, now = rows.sparkSession, [], first
    while now is not None:
        block = Block(spark, now, window)
        parts.append(written(block_scan(rows, key, text, block), "pass"))
        block.sent.destroy()
        now = next(blocks, None)
    return merged(parts)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written, so that it is the same in every scan."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def merged(parts: list[DataFrame]) -> DataFrame:
    """What several blocks found, one row per row number."""
    every = reduce(DataFrame.unionByName, parts)
    found = every.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                own: list[dict] = []
                for s in spans or ():
                    if own and s["begin"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(s)
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind), batch.column(3)], names=batch.schema.names)

    return found.select(ROW, "n_words", "spans", "items").mapInArrow(union, f"{ROW} long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, n_words, spans (merged hit words, half open), items (sorted ids of items that occur).

    Null and empty texts have no words and are never hit; items without words
    or with a null id never occur; repeated items count once.  Every row gives
    a row, whatever its key; other columns are ignored; an empty table gives
    no row.
    """
    blocks = query_blocks(benchmark, item, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return block_scan(docs, key, text, Block(docs.sparkSession, first, window))
    rows = numbered(docs.select(key, text))
    found = pass_by_pass(rows, ROW, text, first, chain([second], blocks), window)
    return rows.select(ROW, key).join(found, ROW).select(key, "n_words", "spans", "items")


def contamination_digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated, from `contamination`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    folded, at, out = text.translate(FOLD), 0, []
    edges = np.frombuffer(b" " + folded + b" ", np.uint8) != 0x20
    begins, ends = np.flatnonzero(edges[1:] & ~edges[:-1]), np.flatnonzero(edges[:-1] & ~edges[1:])
    for a, b in spans:
        out.append(text[at : begins[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all removal spans cut from `text`, every other column as it was.

    A document that loses its last word goes; a document that is not hit stays
    as it is, null and empty ones too.  The spans of all query blocks are found
    on the uncut text, merged, and cut once.
    """
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    blocks = query_blocks(benchmark, "item_id", "text")
    first, second = next(blocks), next(blocks, None)
    block = Block(docs.sparkSession, first, window)

    def cut(batch: pa.RecordBatch, texts: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        new, keep = [], []
        for old, x, own in zip(batch.column(at).to_pylist(), texts, spans, strict=True):
            left = without_spans(x, own) if own else None
            new.append(old if left is None else left.decode())
            keep.append(left is None or bool(words_of(left)))
        columns = [pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    def scan_and_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.phrases()
        for batch in batches:
            texts, spans, held, size = utf8_bytes(batch.column(at)), [], [], 0
            for x in texts:
                held.append(words_of(x))
                size += len(held[-1])
                if size >= SHARD_SYMBOLS:
                    spans += [s for s, _ in phrases.scan(held)]
                    held, size = [], 0
            spans += [s for s, _ in phrases.scan(held)]
            yield cut(batch, texts, spans)

    def cut_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["begin"], s["end"]) for s in own or ()] for own in batch.column(len(names)).to_pylist()]
            yield cut(batch, utf8_bytes(batch.column(at)), spans)

    if second is None:
        return docs.mapInArrow(scan_and_cut, schema)
    rows = numbered(docs)
    found = pass_by_pass(rows, ROW, "text", first, chain([second], blocks), window).where("size(spans) > 0").select(ROW, F.col("spans").alias("_spans"))
    return rows.join(found, ROW, "left").select(*names, "_spans").mapInArrow(cut_found, schema)


def items_digest(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
