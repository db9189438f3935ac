"""SimHash, token counts, suffix dedup, quality rules, decontamination and packing against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from regspark.llm import quality_rules as rules
from regspark.llm.components import components
from regspark.llm.decontaminate import FMIndex, contamination, contamination_digest, decontaminated, without_spans
from regspark.llm.packing import Bins, Encoder, pack_sequences
from regspark.llm.simhash import near_duplicates, near_links, one_of_each, stars
from regspark.llm.substring_dedup import cut_repeats
from regspark.llm.token_counts import byte_balanced, count_tokens, pieces_of

from .conftest import by_id, prose

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def groups(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_equals_brute_force(docs, rows):
    prints = {}
    for r in rows:
        w = words(lower(r[1]))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[r[0]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    df = near_duplicates(docs)
    assert df.count() == len(rows)
    got = by_id(df)
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", want[k]) for k in prints}
    kept = sorted(r.doc_id for r in one_of_each(docs).collect())
    assert kept == sorted(set(want.values()))


def test_links_connect_exactly_the_near(spark):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(60)]
    bits = {0, (1 << 64) - 1, *centre}
    for c in centre[:30]:
        x = c
        for _ in range(12):
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
            bits.add(x)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    df = spark.createDataFrame([(b,) for b in signed], "bits long")
    found = {x.node: x.root for x in components(near_links(df)).collect()}
    want = groups(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert {k: v for k, v in found.items()} == {k: v for k, v in want.items() if list(want.values()).count(v) > 1}


def test_stars_keep_components():
    a, b = np.array([5, 1, 9, 7]), np.array([3, 5, 8, 9])
    x, y = stars(a, b)
    assert groups([1, 3, 5, 7, 8, 9], zip(a.tolist(), b.tolist(), strict=True)) == groups([1, 3, 5, 7, 8, 9], zip(x.tolist(), y.tolist(), strict=True))


def test_token_counts_are_the_library_s(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(count_tokens(docs, limit=100))
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False))
        x = got[r[0]]
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len((r[1] or "").encode()), n, n > 100)


def test_token_counts_of_odd_texts(spark):
    odd = ["<|startoftext|>a b<|endoftext|>", "á ́b", "x y\tz\r\nq\x1cw\x85v", "It's we'll I'd", "Σας ΟΔΟΣ 12345", "a<|endoftext|> b"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(count_tokens(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")))
    assert [got[i].n_tokens for i in range(len(odd))] == [len(library.encode(t, add_special_tokens=False)) for t in odd]


def test_token_counts_of_long_texts_without_spaces(spark):
    r = random.Random(12)
    chinese = "".join(r.choice("的一是不了人我在有他这中大来上国") * (r.random() < 0.9) or r.choice("。，？") for _ in range(40_000))
    base64 = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60_000))
    odd = [chinese, base64, "7" * 20_000, "0é" * 9000, "0e\u0301" * 9000, "x'9s's0'll" * 2000, "ΑΣ0ΒΣ" * 3000, "<|endoftext|>0a" * 1000, "中文。" * 4000 + "'s"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(count_tokens(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")))
    assert [got[i].n_tokens for i in range(len(odd))] == [len(library.encode(t, add_special_tokens=False)) for t in odd]
    assert all(max(map(len, pieces_of(t))) < 4400 for t in (chinese, base64, odd[2], odd[3]))
    assert [sum(len(x.encode()) for x in b) <= 1000 for b in byte_balanced(["中" * 100] * 30, 1000)] == [True] * 10


def test_suffix_dedup_equals_brute_force(docs, rows):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = collections.Counter(t[i : i + 400] for _, t in data for i in range(len(t) - 399))
    df = cut_repeats(docs)
    assert df.count() == len(rows)
    got = by_id(df)
    removed = 0
    for k, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        x = got[k]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(x.kept) == kept
        removed += sum(gone)
    assert removed > 5000


def test_crowded_cores_are_counted(spark, monkeypatch):
    from regspark.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "CROWD", 3)
    shared = prose(11, 90)
    df = spark.createDataFrame([(i, prose(20 + i, 5) + shared[i:] + prose(40 + i, 5)) for i in range(8)], "doc_id long, text string")
    data = {r.doc_id: r.text.encode() for r in df.collect()}
    starts = collections.Counter(t[i : i + 400] for t in data.values() for i in range(len(t) - 399))
    for r in cut_repeats(df).collect():
        t, gone = data[r.doc_id], bytearray(len(data[r.doc_id]))
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        assert r.n_removed == sum(gone) > 0


def base(text):
    w = words(text)
    seen, again, lines = set(), 0, [x for x in (text or "").split("\n") if words(x)]
    for x in lines:
        again += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = collections.Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit), failed


def test_quality_rules_equal_brute_force(docs, rows):
    got = by_id(rules.quality_rules(docs))
    for r in rows:
        x = got[r[0]]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(r[1])
        assert (x.host_rate is None) == (r[3] is None)
        assert not (x.kept and x.base_failed)


def test_bad_host_is_rejected_and_good_one_kept(spark):
    good = [(i, prose(i, 60), f"g{i % 5}") for i in range(100)]
    bad = [(100 + i, "too short" if i < 38 else prose(i, 60), "bad") for i in range(40)]
    got = by_id(rules.quality_rules(spark.createDataFrame(good + bad, "doc_id long, text string, source string")))
    assert all(got[i].kept for i in range(100)) and not any(got[100 + i].kept for i in range(40))


def test_host_verdicts_need_evidence_and_name_the_rule(spark):
    """A host of symbols goes by that rule though its documents pass the base rules; three bad documents are too few."""
    good = [(i, prose(i, 60), f"g{i % 10}") for i in range(300)]
    loud = [(1000 + i, prose(i, 60) + " ###### $$$", "loud") for i in range(40)]
    few = [(2000 + i, "too short", "few") for i in range(3)]
    got = by_id(rules.quality_rules(spark.createDataFrame(good + loud + few, "doc_id long, text string, source string")))
    assert all(got[i].kept and got[i].host_rule is None and got[i].failed_rules == "" for i in range(300))
    assert all(not x.base_failed and not x.kept and x.host_rule == "symbols" and x.failed_rules == "symbols" for x in (got[1000 + i] for i in range(40)))
    assert all(x.base_failed and x.host_rule is None and x.failed_rules == "short" for x in (got[2000 + i] for i in range(3)))


def test_fm_index_finds_all_occurrences():
    r = np.random.default_rng(3)
    text = r.integers(0, 5, 4000)
    index = FMIndex(text)
    for n in range(1, 8):
        at = int(r.integers(0, 3900))
        phrase = np.where(text[at : at + n] == 0, 1, text[at : at + n])
        low, high = index.search(phrase[None, :], np.array([n]))
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_decontamination_equals_brute_force(spark):
    item_words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, prose(100, 30)), (22, prose(101, 12)), (3, "Only four short words"), (4, None), (5, "..."), (1, prose(100, 30)), (7, prose(100, 30).upper())]
    passage = prose(100, 30)
    docs = [
        (1, prose(1, 50) + " " + passage + " " + prose(2, 30)), (2, prose(3, 200)), (3, None), (4, ""), (5, "x only, FOUR-short  words y"), (6, passage.upper() + " " + passage), (7, " ".join(passage.split()[:9])),
        (8, " ".join(passage.split()[5:16])), (9, "é" + passage), (10, prose(101, 12) + "\n" + prose(101, 12)),
    ]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(item_words, lower(t))
        for k in range(max(len(w) - 9, min(1, len(w)))):
            windows[tuple(w[k : k + 10])].add(str(i))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = by_id(contamination_digest(contamination(d, b)))
    for k, t in docs:
        w, hit, own = re.findall(item_words, lower(t)), set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    own |= owners
        x = found[k]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(own), bool(hit))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    left = {r.doc_id: r.text for r in decontaminated(d, b).collect()}
    assert left[2] == docs[1][1] and left[3] is None and left[4] == "" and 6 not in left and passage not in left[1] and left[1].startswith(prose(1, 50))


def test_cutting_spans_keeps_the_rest():
    assert without_spans("Hé, a-b c!".encode(), [(1, 3)]).decode() == "Hé,  c!"


def test_blocks_of_queries_merge(spark, monkeypatch):
    from regspark.llm import decontaminate as dc

    monkeypatch.setattr(dc.query_blocks, "__defaults__", (400,))
    items = spark.createDataFrame([(i, prose(200 + i, 25)) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(300, 10) + " " + prose(200 + i, 25) + " " + prose(201 + i, 25)) for i in range(11)], "doc_id long, text string")
    assert len(list(dc.query_blocks(items, "item_id", "text"))) > 1
    got = by_id(contamination_digest(contamination(docs, items)))
    assert all(r.n_items == 2 and r.n_hit == 50 for r in got.values())


def check_packed(df, rows, size):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    pieces = df.collect()
    sequences, covered = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    copies = collections.Counter(r[0] for r in rows)
    assert covered == {k: len(v) * copies[k] for k, v in ids.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_packing_round_trip(docs, rows):
    sequences = check_packed(pack_sequences(docs, limits=(256, 256, 256)), rows, 256)
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n & (n - 1) == 0 for n in lengths)  # nothing is padded


def test_packing_limits_hold_together():
    examples = [(random.Random(i).randint(1, 90), random.Random(i).randint(0, 60)) for i in range(300)]
    out = []
    Bins((64, 5, 40), 0, lambda *x: out.append(x)).pack(examples)
    sequences = collections.defaultdict(list)
    for k, start, length, sequence, offset in out:
        sequences[sequence].append((offset, length, Bins.loss(type("B", (), {"examples": examples})(), k, start, start + length)))
    for s in sequences.values():
        assert sum(x[1] for x in s) <= 64 and len(s) <= 5 and sum(x[2] for x in s) <= 40
    assert sum(x[2] for x in out) == sum(t for t, _ in examples)


def test_packing_limits_decide_placements():
    """Either limit changes the packing, no sequence breaks one, and none is padded."""
    r = random.Random(8)
    examples = [(n := r.choice([r.randint(2, 40), r.randint(41, 3000)]), int(n * r.random() * 0.3)) for _ in range(400)]
    made = {}
    for limits in ((1024, 6, 960), (1024, 256, 960), (1024, 6, 1024), (1024, 256, 1024)):
        out = []
        bins = Bins(limits, 0, lambda *x, out=out: out.append(x))
        bins.pack(examples)
        sequences = collections.defaultdict(list)
        for k, start, length, sequence, _ in out:
            sequences[sequence].append((length, bins.loss(k, start, start + length)))
        for s in sequences.values():
            total = sum(x[0] for x in s)
            assert total & (total - 1) == 0 and total <= 1024 and len(s) <= limits[1] and sum(x[1] for x in s) <= limits[2]
        covered = collections.defaultdict(list)
        for k, start, length, _, _ in out:
            covered[k].append((start, length))
        for k, pieces in covered.items():
            ends = [a + n for a, n in sorted(pieces)]
            assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] == examples[k][0]
        assert len(covered) == len(examples)
        made[limits] = sorted(out)
    assert len({str(x) for x in made.values()}) == 4


def test_prompt_is_the_first_line(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Ask for it.\n" + prose(3, 50), prose(4, 30), "only a line\n", "", None, "é ß\n中文"]
    df = pack_sequences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = collections.Counter()
    for r in df.collect():
        got[r.doc_id] += r.n_loss
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    line = [len(library.encode(t.split("\n")[0] + "\n", add_special_tokens=False).ids) if t and t.split("\n", 1)[-1] != t and t.split("\n", 1)[1] else 0 for t in texts]
    assert [got[k] for k in range(len(texts))] == [len(i) - n for i, n in zip(ids, line, strict=True)]


def test_encoder_is_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = Encoder()
    for t in ["", " ", "a  b   c", "x \n y\n\n z\t w ", "<|endoftext|>a <|endoftext|> b", "it's 12 34,5", "é ü  \x1c a", prose(9, 300), "a " * 50 + " ", prose(10, 30_000), "x" * 3000, "é中" * 2000]:
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_empty_tables(empty, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (near_duplicates(empty), one_of_each(empty), count_tokens(empty), cut_repeats(empty), rules.quality_rules(empty), pack_sequences(empty), contamination_digest(contamination(empty, items)), decontaminated(empty, items)):
        assert df.count() == 0
