"""Conversation repair against a search through all edits and against parsing every span at every split."""

import hashlib
import heapq
import random
import re

import pytest

from regspark.llm import conversation_repair as cr
from regspark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, place long, _h long"


def search(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The least (cost, audit) by trying edits from the cheapest on; rows are (initial, truncated, gone)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        shape = out if len(out) < 2 else out[-1] + "+"
        if (at, shape) in seen:
            continue
        seen.add((at, shape))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[out[-1:]]
        for role in following:
            if role != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", at, out + role))
            if at < len(rows) and not rows[at][2]:
                late = 5 * rows[at][1]
                if role == rows[at][0]:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, out + role))
                elif role != "s":
                    heapq.heappush(heap, (cost + late + 1, audit + "R", at + 1, out + role))
        if at < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, out))
    raise AssertionError


def every_split(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The textbook's parse: each span, by length, from all its splits."""
    n = len(rows)
    cells = {(i, i): cr.CLOSURE for i in range(n + 1)} | {(i, i + 1): cr.row_cell(*r) for i, r in enumerate(rows)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            parts = [cr.joined(cells[i, k], cells[k, i + length]) for k in range(i, i + length + 1) if (i, k) in cells and (k, i + length) in cells]
            cells[i, i + length] = tuple(min((x for x in c if x), default=None) for c in zip(*parts, strict=True))
    return cr.best_of(cells[0, n])


def random_rows(r: random.Random, n: int) -> list[tuple[str, bool, bool]]:
    return [(r.choice("suauax"), r.random() < 0.2, r.random() < 0.2) for _ in range(n)]


def test_parse_equals_search_and_every_split():
    r = random.Random(3)
    for k in range(600):
        rows = random_rows(r, r.randint(0, 9))
        spans = cr.Spans()
        for x in rows:
            spans.add(x)
        got = cr.best_of(spans.cell())
        assert got == every_split(rows), rows
        if k < 200:
            assert got == search(rows), rows


def test_stretches_cut_anywhere_give_the_same():
    r = random.Random(9)
    for _ in range(60):
        rows = random_rows(r, 60)
        whole, parts = cr.Spans(), cr.Spans()
        for x in rows:
            whole.add(x)
        cuts = sorted({0, 60, *(r.randint(1, 59) for _ in range(r.randint(0, 6)))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = cr.Spans()
            for x in rows[a:b]:
                part.add(x)
            parts.push(1, part.cell())
        assert parts.cell() == whole.cell()


def expected(rows: list[tuple]) -> tuple:
    """The report and the repaired lines of one conversation of (turn, role, text), by plain Python."""
    key = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    rows = sorted(((t, x or " " if x is None else x, y if y is not None else " ") for t, x, y in rows), key=lambda r: (r[0] is not None, r[0] or 0, key(r)))
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        cut = not blank and not again and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
        seen.add((role, text))
        for i, x in enumerate((blank, again and not blank, cut)):
            counts[i] += x
        kinds.append((role[:1], cut, blank or again))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = search(kinds)
    lines, at = [], 0
    for e in audit:
        role, text = (rows[at][1], rows[at][2]) if e in "KR" else (None, "")
        at += e != "I"
        if e != "D":
            turn = len(lines) - (1 if lines and lines[0][0][:1] == "s" else 0)
            lines.append((role if e == "K" else ("user", "assistant")[turn % 2], text))
    out = "\n".join(f"{r}:{t}" for r, t in lines)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest())


def odd() -> list[tuple]:
    """Conversations with nulls, repeats, ties, unknown roles, an empty one and a long one."""
    r = random.Random(4)
    out = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, None, None), (1, None, "user", "First!"), (1, None, "user", "First!")]
    out += [(2, 0, "tool", "x."), (2, 0, "", "y."), (None, 3, "user", "Of no conversation."), (None, 4, "assistant", "Cut off"), (3, None, None, None)]
    for k in range(4, 40):
        out += [(k, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", "system", "user", "assistant", "bot"]), r.choice(["Same.", f"Text {t}.", f"cut {t}", "", " \n"])) for t in range(r.randint(1, 7))]
    out += [(50, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}" + "." * (t % 17 != 5)) for t in range(600) if t % 90 != 7]
    return out


def reports(df) -> dict:
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows_equal_plain_python(spark, partitions):
    d = spark.createDataFrame([(*x, "k", 1, 2) for x in odd()], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # the long conversation lies in several tasks, or in one
    try:
        got = reports(cr.repair_digest(d, d))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by: dict = {}
    for conv_id, *row in odd():
        by.setdefault(conv_id, []).append(tuple(row))
    assert got == {k: expected(rows) for k, rows in by.items()}


def test_repaired_rows_are_conversations(spark):
    d = spark.createDataFrame([(*x, "k", 1, 2) for x in odd()], SCHEMA)
    said: dict = {}
    for r in cr.repaired(d)[1].collect():
        said.setdefault(r.conv_id, []).append((r.place, r.role[:1]))
    assert said and all(re.fullmatch("s?(ua)+", "".join(x for _, x in sorted(v))) for v in said.values())


def test_empty_tables_and_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(7, 0, "user", "x", "k", 1, 2)], SCHEMA)
    assert cr.repair_digest(empty, empty).count() == 0
    assert reports(cr.repair_digest(some, empty)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_plants_each_fault(spark, tmp_path):
    import zlib

    r = random.Random(8)
    rows = [(k, t, r.choice(["user", "assistant"]), f"Text {r.randrange(3)}! What? More") for k in range(80) for t in range(r.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = reports(QUERIES["op12_conversation_repair"](spark, str(tmp_path)))
    by: dict = {k: [] for k, *_ in rows}
    for k, t, role, text in rows:
        h = zlib.crc32(f"{k}:{t}".encode()) % 20
        new = (t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        by[k] += [new] * {0: 0, 3: 2}.get(h, 1)
    want = {k: expected(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k, v in by.items()}
    assert got == want
