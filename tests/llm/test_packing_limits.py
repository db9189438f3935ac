"""Limits of a sequence give way only where a block can't fill sequences within them."""

import collections
import random

from regspark.llm.packing import LIMITS, pack_block, pack_sequences

from .conftest import prose

FREE = 1 << 62


def packed(examples, limits=None):
    sizes, segments, loss, covered = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(list)

    def put(k, start, n, sequence, offset):
        assert offset == sizes[sequence]
        sizes[sequence] += n
        segments[sequence] += 1
        loss[sequence] += max(0, start + n - max(start, examples[k][1]))
        covered[k].append((start, start + n))

    following = pack_block(examples, 5, put, limits)
    assert following == max(sizes) + 1 and min(sizes) == 5 and all(n & (n - 1) == 0 for n in sizes.values())
    for k, (n, _) in enumerate(examples):
        ends = [0, *(b for _, b in sorted(covered[k]))]
        assert [a for a, _ in sorted(covered[k])] == ends[:-1] and ends[-1] == n
    return sum(n for n in sizes.values() if n == LIMITS[0]) / sum(sizes.values()), max(segments.values()), max(loss.values())


def some(n, size, prompt):
    return [(k := size(), min(k, prompt(k))) for _ in range(n)]


def test_short_texts_fill_sequences():
    r = random.Random(4)
    for examples in (some(4000, lambda: r.randint(5, 60), lambda k: FREE), some(2000, lambda: 20, lambda k: FREE), some(2000, lambda: r.randint(10, 120), lambda k: k // 3)):
        share, _, loss = packed(examples)
        assert share >= 0.95 and loss <= LIMITS[2]  # only the number of segments gives way
        assert packed(examples, LIMITS)[0] == 0  # limits given hold, and fill none


def test_long_answers_to_short_prompts_fill_sequences():
    r = random.Random(5)
    for prompt in (lambda k: r.randint(1, 9), lambda k: 0, lambda k: r.randint(1, 30)):
        examples = some(150, lambda: r.randint(1000, 5000), prompt)
        share, segments, _ = packed(examples)
        assert share >= 0.95 and segments <= LIMITS[1]
        assert packed(examples, LIMITS)[0] < 0.8


def test_limits_hold_where_sequences_can_be_filled():
    r = random.Random(6)
    examples = some(300, lambda: r.randint(100, 3000), lambda k: int(k * r.uniform(0.03, 0.3)))
    assert packed(examples) == packed(examples, LIMITS) and packed(examples)[0] >= 0.95


def test_tables_of_short_texts_and_of_titled_ones(spark):
    for texts in ([prose(k, 6) for k in range(1500)], ["Title\n" + prose(k, 1500) for k in range(20)]):
        got = pack_sequences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
        sizes = collections.Counter()
        for r in got:
            sizes[r.sequence_id] += r.length
        assert sum(n for n in sizes.values() if n == 1024) >= 0.8 * sum(sizes.values())
