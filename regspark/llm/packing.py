"""Packing: vector bin packing by the dot-product heuristic.

Every example has a demand in three dimensions: tokens, segments, and
loss-bearing tokens.  The first line of a text with more lines is its prompt,
as in instruction data, and bears no loss; what follows is the answer, and
bears it.  A text without a prompt is no instruction: all of it is learnt, as
far as it goes, and the limit on loss-bearing tokens, which keeps answers from
crowding out prompts, does not count it; it fills what answers may not.  Each task packs the rows of its own
partition: the example with the largest dot product of a bin's remaining
capacity with its demand goes in, and where none fits whole, the head of one.
Examples with equal demand are one class, so a placement looks at classes, not
rows.  A bin that a limit closes early is cut at a power of two, which needs no
padding, and what is beyond the cut waits again.  Limits on segments and loss
that leave too much of a block in such sequences give way for that block.
Sequences take ids from the task's number, so no row is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, worker_cache

TOKENIZER = "byte_bpe_50k"
END = np.uint32(0).tobytes()
BLOCK_TOKENS = 500_000
#: Limits of a sequence: tokens, segments, loss-bearing tokens. The last two give way in blocks that can't fill sequences within them (`tried_limits`).
LIMITS = (1024, 8, 1016)
#: Tokens of a block outside full sequences, above which its limits give way: a share of its tokens, and so many sequences.
UNFILLED = (0.05, 2)
#: Where the loss of a text begins that is no instruction: nowhere.
PLAIN = 1 << 62
#: Characters of a text that are encoded at once.
ENCODED = 1 << 16


class Encoder:
    """Ids as arrays of 32-bit numbers.

    Texts go through the tokenizer's vocabulary given as ranks, which encodes
    them alike in a fifth of the time; those that hold a special string go
    through the tokenizer file itself.  Long texts are cut before spaces that
    stand between two non-space characters; no token crosses such a place.
    """

    def __init__(self, name: str = TOKENIZER):
        import base64
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.size = np.zeros(self.library.get_vocab_size() + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        for token, rank in special.items():
            self.size[rank] = len(token.encode())

    def encode(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        ids, at = [], 0
        while at < len(text):
            place = self.cut.search(text, at + ENCODED) if len(text) - at > ENCODED else None
            end = place.start() if place else len(text)
            ids += self.plain.encode_ordinary(text[at:end])
            at = end
        return np.array(ids, "<u4")

    def prompt(self, text: str, ids: np.ndarray) -> int:
        """How many leading tokens lie within the first line, its end included, if there is more text."""
        line, end, rest = text.partition("\n")
        if not rest:
            return 0
        size = len((line + end).encode())
        return int(np.searchsorted(np.cumsum(self.size[ids[: size + 1]]), size, side="right"))


class Bins:
    """Places pieces of examples in sequences; `put` is called with (example, start, length, sequence, offset).

    An example is (tokens, loss_from): tokens from position loss_from on bear
    loss.  Cuts are free, so a bin is filled up with the head of an example
    that does not fit whole.
    """

    def __init__(self, limits: tuple[int, int, int], first: int, put):
        self.limits, self.next, self.put, self.size = limits, first, put, limits[0]

    def pack(self, examples: list[tuple[int, int]]) -> None:
        self.examples, self.waiting, self.at = examples, {}, {}
        self.demand, self.open = np.zeros((256, 3)), np.zeros(256, bool)
        for k, (tokens, _) in enumerate(examples):
            self._wait(k, 0, tokens)
        while self.open.any():
            self._fill()

    def loss(self, k: int, start: int, end: int) -> int:
        return max(0, end - max(start, self.examples[k][1]))

    def _wait(self, k: int, start: int, end: int) -> None:
        """Stretches of equal demand wait in one class, last in first out."""
        wants = (end - start, 1, self.loss(k, start, end))
        i = self.at.setdefault(wants, len(self.at))
        if i == len(self.demand):
            self.demand, self.open = np.vstack([self.demand, np.zeros_like(self.demand)]), np.concatenate([self.open, np.zeros_like(self.open)])
        self.demand[i], self.open[i] = wants, True
        self.waiting.setdefault(i, []).append((k, start, end))

    def _take(self, i: int) -> tuple[int, int, int]:
        got = self.waiting[i].pop()
        self.open[i] = bool(self.waiting[i])
        return got

    def _fill(self) -> None:
        """One bin: the fitting class with the largest dot product, again and again; where a head fills more, a head."""
        limits = np.array(self.limits, float)
        left, placed = limits.copy(), []
        while left[0] > 0 and left[1] > 0 and self.open.any():
            classes = len(self.at)
            demand, open_ = self.demand[:classes], self.open[:classes]
            head = np.minimum(np.minimum(demand[:, 0], left[0]), demand[:, 0] - demand[:, 2] + left[2]) * open_
            if head.max() <= 0:
                break
            score = demand @ (left / limits / limits)
            fits = open_ & (demand <= left).all(1)
            # the last segment, and the first where something is longer than a bin, go to what fills most
            if not fits.any() or left[1] == 1 or (not placed and demand[open_, 0].max() > self.size):
                i = int(np.argmax(head + score / (1 + score.max())))
            else:
                i = int(np.argmax(np.where(fits, score, -1.0)))
            k, start, end = self._take(i)
            length = int(head[i])
            if start + length < end:
                self._wait(k, start + length, end)
            placed.append((k, start, start + length))
            left -= (length, 1, self.loss(k, start, start + length))
        self._close(placed)

    def _close(self, placed: list[tuple[int, int, int]]) -> None:
        total, at = sum(end - start for _, start, end in placed), 0
        room = self.size if total == self.size else 1 << (total.bit_length() - 1)
        for k, start, end in placed:
            step = min(end - start, room - at)
            if step:
                self.put(k, start, step, self.next, at)
            if start + step < end:
                self._wait(k, start + step, end)
            at += step
        self.next += 1


def tried_limits(examples: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """LIMITS; then segments enough for short texts, four times as many as full sequences have on average; then no limit on loss, for long answers to short prompts.

    What full sequences can't meet even on average is not tried.
    """
    size, segments, loss = LIMITS
    tokens, free = sum(n for n, _ in examples), sum(start for _, start in examples)
    enough = max(segments, -(-4 * size * len(examples) // tokens))
    if size * free >= (size - loss) * tokens:
        if size * len(examples) <= segments * tokens:
            yield LIMITS
        if enough > segments:
            yield size, enough, loss
    yield size, enough, size


def pack_block(examples: list[tuple[int, int]], first: int, put, limits: tuple[int, int, int] | None = None) -> int:
    """Place all examples within `limits`, or without any within the first of `tried_limits` that fills sequences; the next sequence's id."""
    for tried in [limits] if limits else tried_limits(examples):
        pieces: list[tuple[int, int, int, int, int]] = []
        bins = Bins(tried, first, lambda *piece, to=pieces: to.append(piece))
        bins.pack(examples)
        sizes = np.bincount(np.array([s - first for _, _, _, s, _ in pieces]), [n for _, _, n, _, _ in pieces])
        if sizes[sizes < tried[0]].sum() <= UNFILLED[0] * sizes.sum() + UNFILLED[1] * tried[0]:
            break
    for piece in pieces:
        put(*piece)
    return bins.next


def pack_sequences(docs: DataFrame, limits: tuple[int, int, int] | None = None, key: str = "doc_id", text: str = "text", prompt_tokens: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack every row's ids (and a closing id 0) into sequences within `limits`: tokens, segments, loss-bearing tokens of instructions.

    Limits given hold as they are; without any these are LIMITS, which give way
    in a block of which they leave too much outside full sequences.
    `prompt_tokens` names a column with the number of leading tokens that bear
    no loss, null for a text that is no instruction; without it these are the
    tokens of the first line of a text that has more, and other texts are none.  Returns a row per piece: key, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, n_loss (its loss-bearing tokens, which are
    all tokens of a text that is no instruction).  A
    sequence shorter than limits[0] has a power of two of tokens.

    Null and empty texts are the closing id alone.  Repeated rows are packed
    each; a null key stays null; other columns are ignored; an empty table gives
    no piece.
    """
    bounded_batches(docs.sparkSession)
    from pyspark.sql import functions as F

    free = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(PLAIN)) if prompt_tokens else F.lit(None).cast("long")
    source = docs.select(docs[key], docs[text].cast("string"), free.alias("free"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_cache(f"encoder_{tokenizer}", lambda: Encoder(tokenizer))
        out: list[list] = [[] for _ in range(8)]
        keys: list = []
        ids: list[bytes] = []
        examples: list[tuple[int, int]] = []
        bearing: list[int] = []  # where the loss-bearing tokens of a row begin
        key_type = None

        def put(k: int, start: int, length: int, sequence: int, offset: int) -> None:
            loss = max(0, start + length - max(start, bearing[k]))
            row = (keys[k], start, length, zlib.crc32(ids[k][4 * start : 4 * (start + length)]), examples[k][0], sequence, offset, loss)
            for column, value in zip(out, row, strict=True):
                column.append(value)

        sequence_id = TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            nonlocal sequence_id
            sequence_id = pack_block(examples, sequence_id, put, limits)
            made = pa.RecordBatch.from_arrays(
                [pa.array(out[0], key_type), *(pa.array(x, pa.int64()) for x in out[1:])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
            )
            for column in (*out, keys, ids, examples, bearing):
                column.clear()
            return made

        held = 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, x, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = encoder.encode(x or "")
                keys.append(k)
                ids.append(own.tobytes() + END)
                skip = encoder.prompt(x or "", own) or PLAIN if skip is None else max(0, skip)
                examples.append((len(own) + 1, min(skip, len(own) + 1)))
                bearing.append(0 if skip == PLAIN else skip)
                held += len(own) + 1
                if held >= BLOCK_TOKENS:
                    held = 0
                    yield flush()
        if examples:
            yield flush()

    return source.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long")
