"""Token counts: batch encoding in Arrow functions that returns lengths only.

Each text is split at spaces and newlines, where the tokenizer never joins
tokens, and a long stretch without them where a digit or a mark of East Asian
punctuation meets a letter or digit, so a long text never reaches the library
whole (but for a run of letters alone, which is one word to the tokenizer).
The distinct pieces a worker has not met yet are encoded in batches of about
equal bytes; only their lengths are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, utf8_bytes, worker_cache

TOKENIZER = "word_bpe_49k.json"
BATCH_BYTES = 1 << 20
MEMO_PIECES = 400_000
#: Characters from which on a piece without spaces is cut further.
LONG_PIECE = 4096
#: Between two characters that are never in one token, nor composed with each other.
_SAFE = re.compile(r"(?<=[0-9。，、！？；：「」])(?=[^\W_])")


def byte_balanced(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of at most `limit` bytes; a longer piece is a batch of its own."""
    batch, size = [], 0
    for piece in pieces:
        own = len(piece.encode())
        if batch and size + own > limit:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += own
    if batch:
        yield batch


def cut_long(piece: str) -> list[str]:
    """A piece in parts of LONG_PIECE characters, or up to the next safe place after so many."""
    out, at = [], 0
    while len(piece) - at > LONG_PIECE and (place := _SAFE.search(piece, at + LONG_PIECE)):
        out.append(piece[at : place.start()])
        at = place.start()
    return [*out, piece[at:]]


def pieces_of(text: str) -> list[str]:
    """Cut at spaces and newlines; any other white space stays inside a piece."""
    pieces = text.replace("\n", " ").split(" ")
    if len(text) > LONG_PIECE and max(map(len, pieces)) > LONG_PIECE:
        return [part for piece in pieces for part in (cut_long(piece) if len(piece) > LONG_PIECE else (piece,))]
    return pieces


class PieceLengths:
    """Tokens per piece, remembered up to MEMO_PIECES pieces (a full memo starts anew)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[str, int] = {"": 0}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo = {"": 0}
            new = list(pieces)
        for batch in byte_balanced(new):
            for piece, got in zip(batch, self.library.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                self.memo[piece] = len(got)


def groups_by_bytes(texts: list[str | None], sizes: list[int], limit: int = 4 * BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of neighbouring texts with about `limit` bytes each."""
    group, size = [], 0
    for text, own in zip(texts, sizes, strict=True):
        group.append(text or "")
        size += own
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows each give a
    row; other columns are ignored; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(docs[key], docs[text].cast("string"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        known = worker_cache(f"lengths_{tokenizer}", lambda: PieceLengths(public_tokenizers.path(tokenizer)))
        for batch in batches:
            counts: list[int] = []
            sizes = [len(x) for x in utf8_bytes(batch.column(1))]
            for group in groups_by_bytes(batch.column(1).to_pylist(), sizes):
                split = [pieces_of(x) for x in group]
                known.learn(set().union(*split))
                length = known.memo.__getitem__
                counts += [sum(map(length, pieces)) for pieces in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
