"""Scalar functions on text as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boundary and reference patterns (line ends are \n only).
ARTICLE = r"(?md)^((?:Article|Art\.)\s+\d+[a-z]?)\b"
#: Sources whose articles have a form of their own.
OWN_ARTICLE = {"gdpr": r"(?md)^(Article\s+\d+)\b", "fadp": r"(?md)^(Art\.\s+\d+[a-z]?)\b"}
CHAPTER = r"(?md)^(CHAPTER\s+[IVXLCDM]+)"
SECTION = r"(?md)^(Section\s+\d+)"
HEADING = r"(?md)^(\d+(?:\.\d+)*)\s+[A-Z]"
RECITAL = r"(?md)^\((\d+)\)\s"
PARAGRAPH = r"(?md)^(\d+)\.\s"
CROSS_REFERENCE = r"(?:Article|Art\.)\s+\d+[a-z]?(?:\s*\(\d+\))?(?:\s*(?:point|letter)\s*\([a-z]\))?"
FOOTNOTE = r"(?<=[a-z.,;])\d{1,3}(?=\s)"
ARTICLE_NUMBER = r"^(?:Article|Art\.)\s+(\d+[a-z]?)"
#: What an answer says when it lacks evidence.
UNCERTAIN = (
    "insufficient evidence", "not enough information", "cannot determine", "unable to answer", "no specific provision",
    "not addressed", "does not contain sufficient", "beyond the scope", "no information", "cannot find",
)
#: What an answer says that expresses uncertainty, for scoring it.
UNCERTAINTY = (
    "insufficient evidence", "not enough information", "cannot determine", "cannot be determined", "unable to answer", "unable to provide",
    "no specific provision", "not addressed", "not specifically address", "not contain sufficient", "does not contain",
    "beyond the scope", "not available in", "not included in",
    "no mention", "not mentioned", "context does not", "provided context does not", "no information", "cannot find", "not found in",
    "does not specifically", "no direct", "not directly",
)
#: Names for display.
AUTHORITIES = {"statute": "Statute", "guidance": "Regulator Guidance", "commentary": "Commentary"}
SOURCES = {
    "GDPR": "GDPR",
    "FADP": "Swiss FADP",
    "EDPB_CONSENT": "EDPB Guidelines on Consent",
    "EDPB_ARTICLE48": "EDPB Guidelines on Article 48 Transfers",
    "EDPB_LEGITIMATE_INTEREST": "EDPB Guidelines on Legitimate Interest",
    "FDPIC_TECHNICAL_MEASURES": "FDPIC Guide to Technical Measures",
}
TOKENS_PER_WORD = 1.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body uses it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space (that of \\s) at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def words(text: Column) -> Column:
    """Runs of anything but white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int")


def cross_references(text: Column, own: Column | None = None) -> Column:
    """Distinct references, sorted, without the text's own label."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CROSS_REFERENCE), F.lit(0)))
    if own is not None:
        found = F.filter(found, lambda r: F.coalesce(r != own, F.lit(True)))
    return F.array_sort(found)


def has_table(text: Column) -> Column:
    return text.rlike(r"\|[^|\n]*\|") | F.contains(F.lower(F.substring(text, 1, 100)), F.lit("table"))


def has_footnote(text: Column) -> Column:
    return text.rlike(FOOTNOTE)


def article_number(reference: Column) -> Column:
    """The number of a reference, null if it does not start with one."""
    return F.nullif(F.regexp_extract(F.trim(F.regexp_replace(reference, r"\s+", " ")), ARTICLE_NUMBER, 1), F.lit(""))


def short_hash(*parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def chunk_id(source: Column, label: Column, index: Column) -> Column:
    return short_hash(source, F.coalesce(F.nullif(label, F.lit("")), F.lit("none")), index.cast("string"))


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def preview(text: Column, most: int) -> Column:
    """The first characters on one line."""
    return F.concat(F.translate(F.substring(text, 1, most), "\n", " "), F.when(F.length(text) > most, "...").otherwise(""))


def normalised(text: Column) -> Column:
    """Lower case without punctuation (hyphens stay), white space collapsed."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def citations(text: Column) -> Column:
    """Articles and recitals that an answer names, as 'Article n', distinct and sorted."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(?i)Article\s+(\d+)", r"(?i)Art\.\s*(\d+)", r"(?i)Recital\s+(\d+)")))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.concat(F.lit("Article "), n))))


def says_any(text: Column, phrases: tuple[str, ...] = UNCERTAIN) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def named(value: Column, names: dict[str, str]) -> Column:
    """The name of a value for display, or the value."""
    out = value
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def location(*parts: Column) -> Column:
    """Non-empty parts joined by ' > '."""
    return F.coalesce(F.nullif(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " > "), F.lit("")), F.lit("(no location)"))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """The name-based UUID (version 5) of a name; the default namespace is the one for host names."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    )
