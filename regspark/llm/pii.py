"""PII: detected entities get keyed surrogates of the same type and format.

1. A scan lists the distinct entities, each in a canonical form (an e-mail in
   lower case, a phone number as digits, a name word by word), so that all
   mentions of one entity share a surrogate.
2. A keyed hash draws each surrogate.  Two entities with one surrogate, or a
   surrogate that is itself an entity of the corpus, are collisions; all but
   one of the parties draw again, until there is none.  Given names and family
   names are one space.  Forms of fixed length get longer after FIXED_DRAWS
   draws, so that a space that is full has a way out.
3. A second scan writes the surrogates in the format of each mention.  Only
   entities that drew more than once have to be known there: a table that is
   sent along while small, and joined per document beyond that.

Names are known by a title before them, or by a common given name before
another capitalised word; every other mention of these words in the document
follows.  Not looked for: names that neither shows, postal addresses, dates of
birth (a few ten thousand, which can't stay distinct), and runs of digits that
are no valid card number.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Session setting with the key, which is all that keeps surrogates from being inverted; without it every run draws one.
KEY_SETTING = "spark.regspark.surrogateKey"
#: Draws before forms of fixed length get longer, and draws at most.
FIXED_DRAWS, MOST_DRAWS = 16, 200
#: Entities that drew more than once: up to so many are sent to the tasks, more are joined.
SENT = 50_000

#: Titles and the gender they show.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f",
    "Dr": "n", "Prof": "n", "г-н": "m", "Господин": "m", "г-жа": "f", "Госпожа": "f",
}
#: Given names that show a name without a title, and their gender.
GIVEN = {
    **dict.fromkeys("Alexander Andreas Andrew Anthony Antonio Brian Carlos Charles Christian Christopher Daniel David Edward Francisco Frank George Hans Heinrich Henry Jacques James Javier Jean Johann John Jorge José Joseph Juan Kevin Klaus Laurent Louis Luis Manuel Martin Matthew Michael Miguel Nicolas Oliver Patrick Paul Pedro Peter Philippe Pierre Richard Robert Stefan Stephen Thomas Thorsten William Wolfgang Александр Алексей Дмитрий Иван Сергей Γιώργος Νίκος".split(), "m"),
    **dict.fromkeys("Alice Amélie Andrea Angela Anna Barbara Brigitte Carmen Catherine Charlotte Christine Claire Elena Elizabeth Emily Emma Françoise Hannah Helen Ingrid Isabel Isabelle Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucía Margaret Maria María Marie Mary Monika Nathalie Nicole Patricia Petra Rachel Rosa Sabine Sandra Sarah Silvia Sofía Sophie Susan Susanne Teresa Ursula Анна Елена Мария Ольга Ελένη Μαρία".split(), "f"),
}
SYLLABLES = {
    "latin": ["ba", "ce", "do", "fi", "ga", "he", "jo", "ka", "le", "mi", "no", "pa", "re", "so", "ti", "va", "wen", "zor", "bel", "dan", "fer", "gil", "hol", "kar", "lam", "mar", "nel", "rin", "sal", "tor", "vin", "wal"],
    "cyrillic": ["ба", "ве", "го", "ди", "ка", "ле", "ми", "но", "па", "ре", "со", "ти", "фа", "ха", "бор", "вел", "гор", "дан", "кар", "лен", "мир", "нов", "пет", "рин", "сав", "тор", "хар", "чер", "шан", "яр", "ев", "ил"],
    "greek": ["βα", "γε", "δο", "ζι", "θα", "κε", "λο", "μι", "να", "ξε", "πο", "ρι", "σα", "τε", "φο", "χι", "βερ", "γαλ", "δαν", "θεν", "καρ", "λαν", "μαρ", "νελ", "παν", "ριν", "σελ", "τορ", "φιλ", "χαρ", "ψιν", "ωρ"],
}
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "us", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ов", ("greek", "f"): "α", ("greek", "m"): "ος"}
#: What a secret without a digit has: quotes around it, or the beginning that names its kind.
MARKS = ('"', "'", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
CHARACTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")

_NAME_WORD = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = (
    ("email", "@", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("secret", "secret", re.compile(r"(?<![\w+/])(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w+/])|(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key)\b\s*[=:]\s*[\"'])([^\"'\s]{6,})(?=[\"'])")),
    ("iban", "digit", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", "digit", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("ip6", ":", re.compile(r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*[0-9])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|(?:[0-9a-fA-F]{1,4}:){2,7}:|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})(?![\w:])")),
    ("phone", "digit", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\(?0\d{1,4}(?:\)[ ]?|[ /-])\d{3,4}(?:[ -]?\d{2,5}){0,2}|0\d(?:[ .]\d{2}){4})(?!\w|[.,]\d)")),
    ("number", "digit", re.compile(r"(?<![\w.,-])(?:\d{3}-\d{2}-\d{4}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{13,19})(?![\w]|[.,]\d)")),
    ("titled", "title", re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \u00a0]+({_NAME_WORD}(?: {_NAME_WORD}){{0,2}})")),
)
_DIGITS = re.compile(r"\d")
#: A capitalised word before another, with an initial between them or not.
_PAIR = re.compile(rf"\b([A-ZÀ-ÞΆ-ΫА-Я][^\W\d_]+)((?: [A-ZÀ-ÞΆ-ΫА-Я]\.)? {_NAME_WORD}(?: {_NAME_WORD})?)(?!\w)")
_CAPITALISED = re.compile(r"\b[A-ZÀ-ÞΆ-ΫА-Я][^\W\d_]+")


def script_of(word: str) -> str:
    first = word[0].lower()
    return "cyrillic" if "а" <= first <= "я" else "greek" if "α" <= first <= "ω" else "latin"


def names(text: str, titled: re.Pattern | None) -> list[tuple[int, int, str, str]]:
    """Mentions of names: after titles, after common given names, and wherever else the document has their words.

    A title shows the gender of its own mention.  All others of that given name
    in the document have that of the first title that shows one, else the
    common one.
    """
    found: dict[int, tuple[str, str, str]] = {}

    def add(at: int, part: str, gender: str, last_only: bool) -> None:
        words = part.split(" ")
        for i, word in enumerate(words):
            if not word.endswith("."):
                found.setdefault(at, (word, "family" if i == len(words) - 1 or not last_only and i > 0 else "given", gender))
            at += len(word) + 1

    if titled is not None:
        for m in titled.finditer(text):
            add(m.start(2), m[2], TITLES[m[1]], True)
    for m in _PAIR.finditer(text):
        if m[1] in GIVEN:
            add(m.start(1), m[0], "n", False)
    if not found:
        return []
    gender, family = {}, set()
    for word, role, g in (found[at] for at in sorted(found)):
        if role == "family":
            family.add(word.lower())
        elif gender.get(word.lower(), "n") == "n":
            gender[word.lower()] = g if g != "n" else GIVEN.get(word[0] + word[1:].lower(), "n")
    for m in _CAPITALISED.finditer(text):
        word = m[0].lower()
        if m.start() not in found and (word in gender or word in family):
            found[m.start()] = (m[0], "given" if word in gender else "family", "")
    own = lambda word, g: g if g in ("m", "f") else gender[word.lower()]
    return [(at, at + len(word), f"given-{own(word, g)}" if role == "given" else "family", word.lower()) for at, (word, role, g) in found.items()]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) of all mentions, left to right, none overlapping; earlier patterns win."""
    found: list[tuple[int, int, str, str]] = []
    has = {"digit": _DIGITS.search(text) is not None, "title": any(t in text for t in TITLES), "@": "@" in text}
    has["secret"] = has["digit"] or any(x in text for x in MARKS)
    has[":"] = has["digit"] and ":" in text
    for kind, needs, pattern in PATTERNS:
        if kind == "titled":
            found += names(text, pattern if has["title"] else None)
            continue
        if not has[needs]:  # most texts have nothing that a pattern needs
            continue
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "secret" and m[1] else m.span()
            mention = text[a:b]
            if kind == "email":
                b -= len(mention) - len(mention.rstrip(".-"))
                canonical = text[a:b].lower()
            elif kind in ("phone", "number"):
                canonical = "".join(_DIGITS.findall(mention))
                if len(canonical) < 7 or kind == "number" and len(canonical) != 9 and luhn(canonical):
                    continue
            elif kind == "iban":
                canonical = mention.replace(" ", "")
            else:
                canonical = mention.lower() if kind == "ip6" else mention
            found.append((a, b, kind, canonical))
    taken: list[tuple[int, int, str, str]] = []
    rank = {k: i for i, (k, _, _) in enumerate(PATTERNS)}
    found.sort(key=lambda e: (rank.get(e[2], 99), e[0]))
    covered = bytearray(len(text)) if len(found) > 1 else None
    for e in found:
        if covered is None or not any(covered[e[0] : e[1]]):
            taken.append(e)
            if covered is not None:
                covered[e[0] : e[1]] = b"\1" * (e[1] - e[0])
    return sorted(taken)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


class Draw:
    """An endless keyed stream of small numbers."""

    def __init__(self, key: bytes, *what: object):
        self.seed, self.n, self.pool = hmac.new(key, "\0".join(map(str, what)).encode(), hashlib.sha256).digest(), 0, 0
        self.pool = int.from_bytes(self.seed, "big")
        self.size = 1 << 256

    def below(self, n: int) -> int:
        if self.size < n << 40:
            self.n += 1
            self.pool, self.size = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(8, "big")).digest(), "big"), 1 << 256
        self.pool, got = divmod(self.pool, n)
        self.size //= n
        return got

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Each letter or digit by another of its script and case; all else stays."""
        out = []
        for c in text:
            if hexadecimal and c in "0123456789abcdefABCDEF":
                x = "0123456789abcdef"[self.below(16)]
                out.append(x.upper() if text.isupper() else x)
                continue
            for alphabet in CHARACTERS:
                if c in alphabet or c.lower() in alphabet:
                    x = alphabet[self.below(len(alphabet))]
                    out.append(x.upper() if c.isupper() else x)
                    break
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The surrogate in canonical form; kinds of free length get longer with every further attempt, the others later."""
    draw, more = Draw(key, kind, canonical, attempt), max(0, attempt - FIXED_DRAWS)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        host, _, top = domain.rpartition(".")
        label = draw.like(host.split(".")[0] if host and host != "example" else "mail")
        return f"{draw.like(local + 'x' * attempt)}@{label}.example.{top if top in ('com', 'net', 'org') else 'org'}"
    if kind.startswith("given") or kind == "family":
        script, gender = script_of(canonical), kind[6:]
        size = min(4, max(2, len(canonical) // 3)) + attempt
        return "".join(SYLLABLES[script][draw.below(32)] for _ in range(size)) + ENDINGS.get((script, gender), "")
    if kind == "ip" and not more:
        private = canonical.startswith(("10.", "192.168."))
        head = "10" if private else str(240 + draw.below(15))
        return ".".join([head, *(str(draw.below(256)) for _ in range(3))])
    if kind in ("ip", "ip6"):
        return ":".join(["fd00", *(f"{draw.below(65536):x}" for _ in range(7))])
    if kind == "iban":
        rest = draw.like(canonical[4:] + "0" * more)
        value = int("".join(str(int(c, 36)) for c in f"{rest}{canonical[:2]}00"))
        return f"{canonical[:2]}{98 - value % 97:02d}{rest}"
    if kind in ("phone", "number"):
        keep = max(1, len(canonical) - 10) if kind == "phone" else 1
        out = canonical[:keep] + draw.like(canonical[keep:] + "0" * more)
        if kind == "number" and len(canonical) >= 13 and luhn(canonical) == 0:
            out = next(x for d in range(10) if luhn(x := out[:-1] + str(d)) == 0)
        return out
    return draw.like(canonical + canonical[-1:] * more, hexadecimal=re.fullmatch("[0-9a-f]+|[0-9A-F]+", canonical) is not None)


def written_like(kind: str, mention: str, drawn: str) -> str:
    """The surrogate in the format of a mention: its separators, its case."""
    if kind in ("phone", "number"):
        digits = iter(drawn)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        signs = iter(drawn)
        return "".join(c if c == " " else next(signs) for c in mention) + "".join(signs)
    if mention.isupper() and kind not in ("secret", "ip"):
        return drawn.upper()
    if kind == "family" or kind.startswith("given"):
        return drawn[0].upper() + drawn[1:]
    return drawn


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, canonical): every entity of the corpus once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(k, c) for t in batch.column(0).to_pylist() if t for _, _, k, c in entities(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(2)], names=["kind", "canonical"])

    return docs.select(docs[text].cast("string")).mapInArrow(run, "kind string, canonical string").distinct()


def surrogate_table(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt, drawn): no two entities of a space share `drawn`, and none of it is an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [surrogate(k, c, a, key) for k, c, a in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=["kind", "canonical", "attempt", "drawn"])

    def draw(rows: DataFrame) -> DataFrame:
        return rows.select("kind", "canonical", "attempt").mapInArrow(run, "kind string, canonical string, attempt int, drawn string")

    def spaced(rows: DataFrame) -> DataFrame:
        return rows.withColumn("space", F.when((F.col("kind") == "family") | F.col("kind").startswith("given"), "name").otherwise(F.col("kind")))

    entity = spaced(found).select("space", F.col("canonical").alias("drawn"))
    state = written(draw(found.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(MOST_DRAWS):
        own = spaced(state)
        first = own.groupBy("space", "drawn").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("stays"), F.count(F.lit(1)).alias("n"))
        shared = own.join(first.where("n > 1"), ["space", "drawn"]).where("canonical <> stays.canonical or kind <> stays.kind").select("kind", "canonical")
        taken = own.join(entity, ["space", "drawn"], "left_semi").select("kind", "canonical")
        bad = written(shared.unionByName(taken).distinct(), "collisions")
        if bad.isEmpty():
            return state
        again = draw(state.join(bad, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        state = written(state.join(bad, ["kind", "canonical"], "left_anti").select("kind", "canonical", "attempt", "drawn").unionByName(again), "surrogates")
    raise RuntimeError(f"surrogates still collide after {MOST_DRAWS} draws")


def session_key(spark: SparkSession) -> bytes:
    """The key of the session, or one that no one else has."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else secrets.token_bytes(32)


def pseudonymised(text: str, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[str]]:
    """The text with all mentions replaced, and the kinds of what was replaced."""
    at, out, kinds = 0, [], []
    for a, b, kind, canonical in entities(text):
        out += [text[at:a], written_like(kind, text[a:b], surrogate(kind, canonical, attempts.get((kind, canonical), 0), key))]
        kinds.append(kind)
        at = b
    return ("".join([*out, text[at:]]), kinds) if out else (text, kinds)


def pseudonyms(docs: DataFrame, key: bytes | None = None, text: str = "text", counts: bool = False) -> DataFrame:
    """The documents with surrogates in `text`, all other columns as they were.

    Without a key the session's is taken (KEY_SETTING), or a new one for this call.

    With `counts`, also n_entities and entity_kinds (kind:count, sorted, comma
    separated); columns of these names are replaced.  Null stays null, empty
    texts stay empty.  Repeated rows each give a row; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    key = key or session_key(docs.sparkSession)
    drawn = surrogate_table(written(distinct_entities(docs, text), "entities"), key)
    redrawn = drawn.where("attempt > 0").select("kind", "canonical", "attempt")
    names = [c for c in docs.columns if not (counts and c in ("n_entities", "entity_kinds"))]
    rows = docs.select(*names)
    sent: dict[tuple[str, str], int] = {}
    if redrawn.limit(SENT + 1).count() <= SENT:
        sent = {(r.kind, r.canonical): r.attempt for r in redrawn.collect()}
    else:
        rows = with_attempts(rows, redrawn, text)
    extra = rows.columns[len(names) :]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, kinds = [], []
            per_row = batch.column(len(names)).to_pylist() if extra else [None] * batch.num_rows
            for old, own in zip(batch.column(at).to_pylist(), per_row, strict=True):
                mine = {(e["kind"], e["canonical"]): e["attempt"] for e in own} if own else sent
                got = pseudonymised(old, mine, key) if old else (old, [])
                new.append(got[0])
                kinds.append(got[1])
            columns = [pa.array(new, c.type) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            more = [pa.array(list(map(len, kinds)), pa.int64()), pa.array([",".join(f"{k}:{x.count(k)}" for k in sorted(set(x))) for x in kinds], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + more * counts, names=names + ["n_entities", "entity_kinds"] * counts)

    schema = docs.select(*names).schema
    if counts:
        schema = schema.add("n_entities", "long").add("entity_kinds", "string")
    return rows.mapInArrow(run, schema)


def with_attempts(rows: DataFrame, redrawn: DataFrame, text: str) -> DataFrame:
    """The rows with an array of those of their entities that drew more than once, by a join on a name for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [(u, k, c) for u, t in zip(*(x.to_pylist() for x in batch.columns), strict=True) if t for k, c in {e[2:] for e in entities(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in listed], pa.int64()), *(pa.array([x[i] for x in listed], pa.string()) for i in (1, 2))], names=["u", "kind", "canonical"])

    name = F.xxhash64(F.col(text))
    mentions = rows.select(name.alias("u"), F.col(text)).mapInArrow(run, "u long, kind string, canonical string").distinct()
    own = mentions.join(redrawn, ["kind", "canonical"]).groupBy("u").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("own"))
    columns = [rows[c] for c in rows.columns]
    return rows.join(own, name == own["u"], "left").select(*columns, own["own"])
