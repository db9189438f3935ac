"""Documents with everything that operators have to bear."""

import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, k long, host string, u long, w string, h string, t string, bits long, words string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = "an be co du er fi ga he in jo ka le mi no or pa re st ti un".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def texts() -> list[str | None]:
    base, shared = prose(1, 150), prose(2, 120)
    near = base.split()
    near[70] = "changed"
    return [
        base, base, " ".join(near), None, "", "   \n\t ", "one", "one two three", prose(3, 40) + "\n" + shared + "\n" + prose(4, 60), prose(5, 30) + " " + shared + " tail",
        "same line here again\nsame line here again\n" + prose(6, 20), prose(7, 9000), "x" * 5000, "é́ 中文 \U0001f600 ß word " * 20, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab", "### *** $$$ %%% " * 30,
    ]


@pytest.fixture(scope="session")
def rows():
    """Ids with gaps, one repeated row, clashing extra columns, null in any column."""
    out = [(3 * i + 1, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, i, "h", None, "w", "h", "t", 0, "words") for i, t in enumerate(texts())]
    return [*out, out[0]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def by_id(df) -> dict:
    """Rows by doc_id; equal rows for a repeated document are one."""
    out: dict = {}
    for r in df.collect():
        assert r.doc_id not in out or out[r.doc_id] == r
        out[r.doc_id] = r
    return out
