"""Repair of conversations: weighted interval parsing with a repair grammar in Chomsky normal form.

A repaired conversation is empty, or an optional system turn and then user and
assistant turns by turns: the language (s?(ua)+)? of role initials.  Its four
states are START, after the system turn, after a user turn, after an assistant
turn; the grammar has a nonterminal N[p, q] for every two of them, which derives
the rows of a span, edited so that they lead from p to q:

    N[p, q] -> N[p, r] N[r, q]      two spans, side by side
    N[p, q] -> row                  kept, given another role, or deleted (p = q)
    N[p, q] -> nothing              turns that are put in; the closure of this rule is part of every cell

A cell has the least (cost, audit) of a span for each nonterminal; audits are
the initials of the edits.  Cells are put together bottom up by span length.
As the nonterminals say how a span begins and ends, every split of a span gives
the same cell, so spans of length 1, 2, 4, ... are enough where a grammar at
large needs them all: the work is linear in the rows.  For the same reason a long
conversation may be cut anywhere: range partitioning deals its rows to many
tasks, each parses its stretches, and a stretch leaves its task as one cell.

Least audits of parts are parts of the least audit: audits that derive the same
rows at the same cost are never one the beginning of the other, since what one
has more would be turns put in, which cost something.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, rows_of, written
from .sql import crc32_sql

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Role initial: the steps it takes.
STEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NAMES = ("user", "assistant")
LEGAL_PAIRS = ("su", "ua", "au")
PARSED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

#: A cell: (cost, audit), or None, for each (p, q) in the order of p, then q.
Cell = tuple[tuple[int, str] | None, ...]


def joined(x: Cell, y: Cell) -> Cell:
    """The cell of two spans side by side."""
    out = []
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                a, b = x[4 * p + r], y[4 * r + q]
                if a and b and (best is None or (a[0] + b[0], a[1] + b[1]) < best):
                    best = (a[0] + b[0], a[1] + b[1])
            out.append(best)
    return tuple(out)


def closure() -> Cell:
    """The cell of no rows: turns put in, as many as it takes."""
    nothing = tuple((0, "") if p == q else None for p in STATES for q in STATES)
    one = tuple((0, "") if p == q else (INSERT, "I") if (p, q) in STEPS["u"] + STEPS["a"] else None for p in STATES for q in STATES)
    out = nothing
    for _ in STATES:  # a way through the states never visits one twice
        out = joined(out, one)
    return out


CLOSURE = closure()


@lru_cache(maxsize=64)
def row_cell(initial: str, truncated: bool, deleted: bool) -> Cell:
    """The cell of one row, closed under insertion; `deleted` rows have to go."""
    late = TRUNCATED * truncated
    out: list = [(DELETE, "D") if p == q else None for p in STATES for q in STATES]
    for role, steps in STEPS.items():
        for p, q in steps if not deleted else ():
            edit = (late, "K") if role == initial else (late + REROLE, "R") if role != "s" else None
            if edit:
                out[4 * p + q] = edit
    return joined(joined(CLOSURE, tuple(out)), CLOSURE)


@lru_cache(maxsize=1 << 13)
def short_span(kinds: tuple[tuple[str, bool, bool], ...]) -> Cell:
    return row_cell(*kinds[0]) if len(kinds) == 1 else joined(short_span(kinds[: len(kinds) // 2]), short_span(kinds[len(kinds) // 2 :]))


class Spans:
    """Cells of neighbouring spans of a stretch of rows, longer ones first; spans of equal length are joined."""

    def __init__(self):
        self.cells: list[tuple[int, Cell]] = []
        self.new: list[tuple[str, bool, bool]] = []

    def push(self, length: int, cell: Cell) -> None:
        while self.cells and self.cells[-1][0] <= length:
            before, other = self.cells.pop()
            length, cell = length + before, joined(other, cell)
        self.cells.append((length, cell))

    def add(self, kind: tuple[str, bool, bool]) -> None:
        self.new.append(kind)
        if len(self.new) == 4:
            self.flush()

    def flush(self) -> None:
        if self.new:
            self.push(len(self.new), short_span(tuple(self.new)))
            self.new = []

    def cell(self) -> Cell:
        self.flush()
        out = CLOSURE
        for _, cell in reversed(self.cells):
            out = joined(cell, out)
        return out


def best_of(cell: Cell) -> tuple[int, str]:
    return min(cell[4 * START + q] for q in ENDS if cell[4 * START + q])


def tidy(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes out its [.!?], 3 repeats it, 4 makes it the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = tidy(conversations).withColumn("_h", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = d.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "_h")
    return d.withColumn("_n", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_h", "_n")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with `key`, a digest of role and text, by which rows of one turn are ordered."""
    return tidy(rows).withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")))


def faults(rows: DataFrame) -> DataFrame:
    """Per row of `keyed`: conv_id, turn, key, initial, blank, late (an equal row has an earlier turn), truncated."""
    flat = rows.select(
        "conv_id", "turn", "key", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated")
    )
    seen = flat.groupBy("conv_id", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = written(seen.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k"), "first"), "repeated")
    d = flat.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")), "left")
    return d.select("conv_id", "turn", "key", "initial", "blank", (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("late"), "truncated")


class Stretch:
    """What is known of neighbouring rows of one conversation."""

    def __init__(self, turn: int | None, key: str, initial: str):
        self.first = (turn is not None, turn, key)
        self.turn, self.key, self.initials = object(), None, [initial, initial]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.span: list[int | None] = [None, None]
        self.spans, self.empty = Spans(), True

    def add(self, turn: int | None, key: str, initial: str, blank: bool, late: bool, truncated: bool) -> None:
        duplicate = not blank and (late or (not self.empty and turn == self.turn and key == self.key))
        truncated = truncated and not blank and not duplicate
        for name, met in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += met
        if not self.empty:
            self.counts["illegal"] += self.initials[1] + initial not in LEGAL_PAIRS
        if turn is not None:
            self.counts["turns"] += self.empty or turn != self.turn
            self.span = [turn if self.span[0] is None else self.span[0], turn]
        self.turn, self.key, self.initials[1], self.empty = turn, key, initial, False
        self.spans.add((initial, truncated, blank or duplicate))

    def row(self) -> dict:
        cell = self.spans.cell()
        costs, audits = zip(*((-1, "") if c is None else c for c in cell), strict=True)
        begin = dict(zip(("known", "turn", "key"), self.first, strict=True))
        return {**begin, **self.counts, "low": self.span[0], "high": self.span[1], "from": self.initials[0], "to": self.initials[1], "costs": list(costs), "audits": list(audits)}


STRETCH = (
    "struct<known:boolean,turn:long,key:string,blank:long,duplicate:long,truncated:long,illegal:long,turns:long,low:long,high:long,`from`:string,`to`:string,costs:array<long>,audits:array<string>>"
)
_LONGS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_ARROW = pa.struct(
    [("known", pa.bool_()), ("turn", pa.int64()), ("key", pa.string()), *((c, pa.int64()) for c in _LONGS), ("from", pa.string()), ("to", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def stretches(marked: DataFrame) -> DataFrame:
    """(conv_id, part): the cell and the counts of every stretch of a conversation that one task has."""
    bounded_batches(marked.sparkSession)
    order = ["conv_id", "turn", "key"]
    columns = [*order, "initial", "blank", "late", "truncated"]
    ordered = marked.select(columns).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ordered.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, now, at, type_ = [], [], None, None, None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(parts, _ARROW)], names=["conv_id", "part"])
            ids.clear()
            parts.clear()
            return batch

        for batch in batches:
            type_ = batch.schema.field(0).type
            for conv_id, turn, key, *rest in rows_of([batch], *columns):
                if now is None or conv_id != at:
                    if now is not None:
                        ids.append(at)
                        parts.append(now.row())
                    now, at = Stretch(turn, key, rest[0]), conv_id
                now.add(turn, key, *rest)
            if len(ids) > 500:
                yield out()
        if now is not None:
            ids.append(at)
            parts.append(now.row())
            yield out()

    return ordered.mapInArrow(run, f"conv_id {kind}, part {STRETCH}")


def summed(parts: list[dict]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation's stretches in order."""
    counts = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    spans, last, low, high = Spans(), None, None, None
    for p in parts:
        spans.push(1, tuple((c, a) if c >= 0 else None for c, a in zip(p["costs"], p["audits"], strict=True)))
        if last is not None:
            counts["illegal"] += last["to"] + p["from"] not in LEGAL_PAIRS
        if p["low"] is not None:
            counts["turns"] -= high == p["low"]
            low, high = p["low"] if low is None else low, p["high"]
        last = p
    gaps = 0 if low is None else high - low + 1 - counts["turns"]
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], *best_of(spans.cell())


def parsed(rows: DataFrame) -> DataFrame:
    """Per conversation of `keyed` rows: conv_id and PARSED."""
    gathered = stretches(written(faults(rows), "faults")).groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    kind = gathered.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summed(parts) for parts in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.string())], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return gathered.mapInArrow(run, f"conv_id {kind}, {PARSED}")


def edited(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations; the rows of one lie in one partition, in order.

    The audit comes before its rows, so a conversation streams through its task.
    """
    bounded_batches(rows.sparkSession)
    audits = reports.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(rows.select("conv_id", F.lit(1).alias("_kind"), "turn", "key", "role", "text"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "key").select("conv_id", "_kind", "role", "text")
    kind = ordered.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, audit, done, place, shift, type_, size = [], None, "", 0, 0, 0, None, 0

        def batch_of() -> pa.RecordBatch:
            ids, *rest = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(ids, type_), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=["conv_id", "place", "edit", "role", "text"])

        def inserted() -> None:
            nonlocal done, place
            while done < len(audit) and audit[done] == "I":
                out.append((at, place, "I", NAMES[(place - shift) % 2], ""))
                done, place = done + 1, place + 1

        for batch in batches:
            type_ = batch.schema.field(0).type
            for conv_id, row_kind, role, text in rows_of([batch], "conv_id", "_kind", "role", "text"):
                if row_kind == 0:
                    inserted()
                    at, audit, done, place, shift = conv_id, text, 0, 0, 0
                    continue
                inserted()
                edit, done = audit[done], done + 1
                if edit != "D":
                    if place == 0 and edit == "K" and role[:1] == "s":
                        shift = 1
                    out.append((at, place, edit, role if edit == "K" else NAMES[(place - shift) % 2], text))
                    place, size = place + 1, size + len(text)
                if size > 1 << 22 or len(out) > 5000:
                    yield batch_of()
                    out, size = [], 0
        inserted()
        if out:
            yield batch_of()

    return ordered.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report (conv_id, PARSED) of every conversation, and its repaired rows (conv_id, place, edit, role, text).

    Rows are taken by turn, null turns first, rows of one turn by a digest of
    role and text.  A null role or text is one space; the rows with a null
    conv_id are one conversation; repeated rows are duplicates; other columns
    are ignored; an empty table gives no row in either.
    """
    rows = keyed(conversations)
    reports = written(parsed(rows), "reports")
    return reports, edited(rows, reports)


def hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `edited` rows, "role:text" joined by newlines, as they stream by."""
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out, type_ = None, None, [], None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for conv_id, place, role, text in rows_of([batch], "conv_id", "place", "role", "text"):
                if place == 0:
                    if digest:
                        out.append((at, digest.hexdigest()))
                    at, digest = conv_id, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
        if digest:
            out.append((at, digest.hexdigest()))
            ids, found = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type_), pa.array(found)], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_digest(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every conv_id of `conversations`: the report on its `rows` and the hash of what they become; zeros without rows."""
    reports, edits = repaired(rows)
    found = hashes(edits)
    ids = conversations.select("conv_id").distinct()
    d = ids.join(reports.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    d = d.join(found.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """One row after the other: for each state the least (cost, audit), as the cost in nine digits and the audit."""
    add = lambda s, cost, edit: f"lpad(CAST(CAST(substr({s}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || {edit}"
    least = lambda *x: "least(" + ", ".join(x) + ")"
    one, two = f"{INSERT}, 'I'".split(", "), f"{2 * INSERT}, 'II'".split(", ")
    closed = [
        "s0", "s1", least("s2", *(add(s, *one) for s in ("s0", "s1", "s3"))), least("s3", add("s2", *one), add("s0", *two), add("s1", *two)),
    ]
    closed = ", ".join(f"{c} AS s{k}" for k, c in enumerate(closed))
    deleted = [add(f"p.s{k}", DELETE, "'D'") for k in STATES]
    role = lambda s, r: "CASE WHEN NOT gone THEN " + add(s, f"late + CASE WHEN initial = '{r}' THEN 0 ELSE {REROLE} END", f"CASE WHEN initial = '{r}' THEN 'K' ELSE 'R' END") + " END"
    kept = "CASE WHEN NOT gone AND initial = 's' THEN " + add("p.s0", "late", "'K'") + " END"
    step = ", ".join((deleted[0], least(deleted[1], kept), least(deleted[2], *(role(f"p.s{k}", "u") for k in (0, 1, 3))), least(deleted[3], role("p.s2", "a"))))
    named = "SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS crc_of FROM conversations"
    return rf"""WITH RECURSIVE {crc32_sql("h", named)},
hurt AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role, CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
r AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text), copy) AS k FROM hurt),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM r),
g AS (SELECT *, blank OR seen AS gone, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS late FROM f),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(blank) AS BIGINT) AS blank, CAST(count_if(seen AND NOT blank) AS BIGINT) AS duplicate,
  CAST(count_if(cut AND NOT seen AND NOT blank) AS BIGINT) AS truncated, CAST(count_if(pair NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, max(k) AS n FROM g GROUP BY conv_id),
dp(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM counts UNION ALL
  SELECT p.conv_id, g.k, {step} FROM (SELECT conv_id, k, {closed} FROM dp) p JOIN g ON g.conv_id = p.conv_id AND g.k = p.k + 1),
best AS (SELECT d.conv_id, least(s0, s3) AS s FROM (SELECT conv_id, k, {closed} FROM dp) d JOIN counts c ON c.conv_id = d.conv_id AND c.n = d.k),
audits AS (SELECT conv_id, CAST(substr(s, 1, 9) AS BIGINT) AS cost, substr(s, 10) AS audit FROM best),
edits AS (SELECT conv_id, i, substr(audit, i, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM audits)),
placed AS (SELECT *, count_if(e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS k, count_if(e <> 'D') OVER (PARTITION BY conv_id ORDER BY i) - 1 AS place FROM edits),
rows_out AS (SELECT p.conv_id, place, e, role, initial, text, first_value(CAST(e = 'K' AND initial = 's' AS INT)) OVER (PARTITION BY p.conv_id ORDER BY place) AS shift
  FROM placed p LEFT JOIN g ON g.conv_id = p.conv_id AND g.k = p.k AND e <> 'I' WHERE e <> 'D'),
lines AS (SELECT conv_id, place, CASE WHEN e = 'K' THEN role WHEN (place - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM rows_out),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS repaired_sha256 FROM lines GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN hashed USING (conv_id)"""


SQL = _sql()
