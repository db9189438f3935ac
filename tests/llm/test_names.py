"""Names: found by title or given name, replaced alike all over a document, distinct over the corpus; draws that end."""

import random
import re

from regspark.llm import pii

from .conftest import by_id

KEY = b"test key"


def replaced(text: str) -> str:
    return pii.pseudonymised(text, {}, KEY)[0]


def test_titled_name_is_replaced_wherever_it_stands():
    new = replaced("Mr John Smith met us. John Smith left, and Smith paid.")
    m = re.fullmatch(r"Mr (\w+) (\w+) met us\. (\w+) (\w+) left, and (\w+) paid\.", new)
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] and not {"John", "Smith"} & set(new.replace(".", " ").split())


def test_untitled_names_case_and_initials():
    new = replaced("Anna B. Schmidt sang. ANNA and Schmidt's dog; Anna-like.")
    assert "nna" not in new.lower() and "chmidt" not in new and new.split()[1] == "B."
    assert replaced("The John came. Paul the cat. Of Of The The.") == "The John came. Paul the cat. Of Of The The."
    assert {k for _, _, k, _ in pii.entities("Dr Alex Kim and Mrs Alex Kim")} == {"given-f", "family"}


def test_addresses_and_phones():
    kinds = lambda t: [k for _, _, k, _ in pii.entities(t)]
    for t in ("fe80::1", "::1", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8"):
        assert kinds(f"host {t} up") == ["ip6"], t
    for t in ("030 1234567", "0171-1234567", "(020) 7946 0958", "06 12 34 56 78", "+49 30 1234567"):
        assert kinds(f"call {t} now") == ["phone"], t
    for t in ("at 10:30", "std::vector a::b", "12:30:45", "id 123456789012", "order 1234567812345678", "version 3.1.2", "0.05 7.25"):
        assert kinds(t) == [], t


def test_given_and_family_names_share_no_surrogate(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfgk") + r.choice("aeiou") for _ in range(3))
    found = {(k, word()) for _ in range(2500) for k in ("given-m", "given-f", "given-n", "family")}
    table = pii.surrogate_table(spark.createDataFrame(sorted(found), "kind string, canonical string"), KEY).collect()
    drawn = [x.drawn for x in table]
    assert len(table) == len(found) and len(set(drawn)) == len(drawn) and not set(drawn) & {c for _, c in found}
    assert any(x.attempt for x in table)


def test_a_full_space_has_a_way_out(spark):
    """All numbers of a form are entities, so that none is left to draw."""
    secrets = [("secret", f"{i:02d}") for i in range(100)]
    table = pii.surrogate_table(spark.createDataFrame(secrets, "kind string, canonical string"), KEY).collect()
    drawn = [x.drawn for x in table]
    assert len(set(drawn)) == 100 and not set(drawn) & {c for _, c in secrets} and max(map(len, drawn)) > 2
    assert pii.written_like("phone", "(03) 12-34", "987654") == "(98) 76-54" and pii.written_like("phone", "03-1", "98765") == "98-765"


def test_coreference_over_documents_equals_brute_force(spark):
    """Every mention's surrogate is a function of its kind and canonical form, one to one, and all else stays."""
    people = ["Mr Karl Otto", "Mrs Jane Doe", "Herr Doe", "Laura Palmer", "Dr Palmer"]
    r = random.Random(6)
    texts = [f"{r.choice(people)} wrote to x{i % 7}@mail.example.com from 10.0.0.{i % 9}; call +1 (743) 555-{3000 + i % 11}." for i in range(80)]
    got = by_id(pii.pseudonyms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), KEY))
    seen: dict = {}
    for i, t in enumerate(texts):
        parts, at = [], 0
        for a, b, _, _ in pii.entities(t):
            parts += [re.escape(t[at:a]), "(.+?)"]
            at = b
        m = re.fullmatch("".join([*parts, re.escape(t[at:])]), got[i].text)
        assert m
        for (_, _, kind, canonical), new in zip(pii.entities(t), m.groups(), strict=True):
            assert seen.setdefault((kind, canonical), new) == new != canonical
    assert len(set(seen.values())) == len(seen)


def test_key_comes_from_the_session_or_is_new(spark):
    df = spark.createDataFrame([(1, "write a.b@m.example.com")], "doc_id long, text string")
    text = lambda: pii.pseudonyms(df).first().text
    assert text() != text()
    spark.conf.set(pii.KEY_SETTING, "given")
    try:
        assert text() == text() == pii.pseudonyms(df, b"given").first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
