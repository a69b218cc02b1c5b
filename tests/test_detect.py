"""Detectors, checksums, languages, lists and sequential rules."""

import re

import pytest
from pyspark.sql import functions as F

from quillon import fixtures, queries
from quillon.functions import checks, labels
from quillon.operators import detectors as D
from quillon.operators import language, lists, ner
from quillon.operators import sequential as S
from quillon.operators.detect import Options, active_languages
from quillon.plans import anonymize as A
from quillon.sources import config

CASES = [
    ("EmailRegex", "mail a.b@c-d.org now", ["a.b@c-d.org"]), ("EmailRegex", "no at sign", []),
    ("PhoneFrRegex", "Tel 01 23 45 67 89.", ["01 23 45 67 89"]), ("PhoneFrRegex", "ref 123456789012345", []),
    ("PhoneUsRegex", "call (743) 555-3824", ["(743) 555-3824"]), ("SiretRegex", "SIRET 123 456 789 00012", ["123 456 789 00012"]),
    ("SirenRegex", "SIREN 123 456 789", ["123 456 789"]), ("SirenRegex", "nombre 123 456 789", []), ("VatFrRegex", "FR 40 123 456 789", ["FR 40 123 456 789"]), ("VatFrRegex", "fr40123456789", []),
    ("IbanRegex", "IBAN GB82 WEST 1234 5698 7654 32 x", ["GB82 WEST 1234 5698 7654 32"]), ("IbanRegex", "GB83 WEST 1234 5698 7654 32", []), ("IbanRegex", "IBAN GB83 WEST 1234 5698 7654 32", ["GB83 WEST 1234 5698 7654 32"]),
    ("IbanRegex", "ZZ82 WEST 1234", []), ("BicRegex", "BIC PSSTFRPPPAR", ["PSSTFRPPPAR"]), ("BicRegex", "PSSTFRPPPAR alone", []), ("BicRegex", "SWIFT VIREMENT", []),
    ("RibFrRegex", "RIB : 30002 00550 0000157841Z 25", ["30002 00550 0000157841Z 25"]), ("RibFrRegex", "RIB : 30002 00550 0000157841Z 26", []),
    ("UrssafRegex", "URSSAF 117 1234567 89", None), ("HmrcRefRegex", "nothing", []), ("PlPeselRegex", "PESEL: 44051401359", ["44051401359"]), ("PlPeselRegex", "44051401359", []),
    ("CnHkidRegex", "HKID: A", []), ("NameCommaRegex", "MARTIN, Jean", ["MARTIN, Jean"]), ("ParenContentRegex", "(offre DUPONT)", ["(offre DUPONT)"]), ("ParenContentRegex", "(tout petit)", []),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = sorted({t for _, t, _ in CASES})
    rows = D.prepared(spark.createDataFrame([(t,) for t in texts], "text string"))
    tags = sorted({tag for tag, _, _ in CASES})
    columns = [F.flatten(F.array(*[D.spans_of(d) for d in D.ALL if d.tag == tag])).alias(tag) for tag in tags]
    return {r["text"]: {t: [s["text"] for s in r[t]] for t in tags} for r in rows.select("text", *columns).collect()}


@pytest.mark.parametrize("tag,text,wanted", CASES)
def test_detector(found, tag, text, wanted):
    if wanted is not None:
        assert found[text][tag] == wanted


def test_checksums(spark):
    rows = spark.createDataFrame([("GB82WEST12345698765432", True), ("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765433", False), ("GB82", False), ("", False)], "t string, ok boolean")
    assert all(a == b for a, b in rows.select(checks.iban_valid(F.col("t")), "ok").collect())


def test_languages(spark):
    rows = D.prepared(spark.createDataFrame([(1, "Sitz der Gesellschaft", None), (2, "one Ltd and one LLC", "fr"), (3, "nothing", "ja"), (4, None, "es")], "id int, text string, lang string"))
    got = {r["id"]: set(r["l"]) for r in rows.select("id", active_languages("lang").alias("l")).collect()}
    assert got[1] == {"de"} and {"fr", "en"} <= got[2] and got[3] == {"fr"} and got[4] == {"es"}


def test_lists(spark):
    rows = spark.createDataFrame([("At ACME-Corp and acmecorp in Orléans, not xAcme Corpx",)], "text string")
    got = rows.select(lists.organizations("text", ("Acme Corp", "Acme")).alias("o"), lists.organizations_loose("text", ("Acme Corp",)).alias("l"), lists.places("text", ("Orleans",)).alias("p"), lists.people("text", ()).alias("e")).first()
    assert [s["text"] for s in got["o"]] == ["ACME-Corp", "acmecorp"] and len(got["l"]) == 3 and [s["text"] for s in got["p"]] == ["Orléans"] and got["e"] == []


def test_table_columns():
    got = [(s.entity_type, s.text) for s in S.table_columns(fixtures.TABLE)]
    assert got == [("CLIENT_CODE", "C-55120"), ("ORDER_REF", "4500987654")]
    assert S.table_columns("Client\nC-55120\n") == []


def test_order_reference_reaches_three_lines_and_stops_at_other_labels():
    assert [s.text for s in S.order_references("Votre commande :\n\n4500123456\n")] == ["4500123456"]
    assert S.order_references("Votre commande :\nCode client\n4500123456\n") == []


def test_propagation_covers_initials_parts_and_acronyms():
    text = "Julien MARCHAND writes. J. Marchand and marchand agree. Not marchandise."
    s = [S.Span(0, 15, "PERSON", text[:15], 0.9, "X", {})]
    assert [x.text for x in S.propagated(text, s)[1:]] == ["J. Marchand", "marchand"]


def test_person_expansion_ends_at_the_line():
    text = "Jean\nDupont x"
    got = S.persons_on_line(text, [S.Span(0, 11, "PERSON", text[:11], 0.8, "X", {})])
    assert got[0].text == "Jean"


def test_allow_list_and_table_body():
    text = fixtures.TABLE
    at = text.index("Roulement")
    inside = S.Span(at, at + 9, "PERSON", "Roulement", 0.8, "PrenomNomRegex", {})
    assert S.outside_tables(text, [inside], fixtures.LEXICON) == []
    assert S.allowed(text, [inside], fixtures.LEXICON, ()) == []
    assert S.allowed(text, [inside._replace(recognizer="EmailRegex")], fixtures.LEXICON, ("(",)) != []
    assert S.allowed(text, [inside], (), (r"Roul\w+",)) == []


def test_model_hook(spark):
    rows = spark.createDataFrame([(1, "Ada met 123 in Rome")], "doc_id int, text string").withColumn("spans", F.array().cast(D.SPANS))
    model = lambda: lambda t: [(0, 3, "person", 0.9), (8, 11, "person", 0.9), (15, 19, "location", 0.2)]
    assert [s["text"] for s in ner.with_model(rows, model).first()["spans"]] == ["Ada"]
    assert "".join(p for _, p in ner.chunks("ab\n" * 700)) == "ab\n" * 700


@pytest.mark.parametrize("family", [*queries.FAMILIES.values(), "bank", "person", "reference"])
def test_each_family_finds_something(spark, family):
    assert A.spans(fixtures.documents(spark), Options(families=(family,), **queries.BARE)).where(F.size("spans") > 0).count() > 0


@pytest.mark.parametrize("kind", list(labels.TABLE_LABELS))
def test_every_table_label_types_its_value(kind):
    for label in labels.TABLE_LABELS[kind]:
        # the value under a label that two kinds have is of the later kind
        wanted = [k for k, v in labels.TABLE_LABELS.items() if label in v][-1]
        got = S.table_columns(f"Page\n{label.title()} :\n12/03\nK-4711\n")
        assert [(s.entity_type, s.text) for s in got] == [(wanted, "K-4711")], label


def test_neutral_and_other_labels():
    assert S.table_columns("Kunden Nr\nLieferadresse\nK-4711\nHafen 3\n") != []
    for label in labels.NEUTRAL_LABELS:
        if S.LABELS[label] is None:
            assert [s.text for s in S.table_columns(f"{label}\nclient\nfirst 1\nsecond 2\n")] == ["second 2"], label
    for other in ("total recall", "date limite", "telling"):
        assert S.table_columns(f"{other}\nclient\nfirst 1\nsecond 2\n") == []
    assert S.table_columns("client\n\nvotre commande\nfirst 1\nsecond 2\n") == []


def test_persons_do_not_grow_over_noise():
    def grown(text, name):
        at = text.index(name)
        return [s.text for s in S.persons_on_line(text, [S.Span(at, at + len(name), "PERSON", name, 0.8, "X", {})])[1:]]

    assert grown("Monsieur Jean Dupont Telephone", "Jean Dupont") == []
    assert grown("Madame DERENTINGER Melanie", "DERENTINGER") == ["DERENTINGER Melanie"]
    assert grown("Jean Luc\nKLEE\n", "Jean Luc") == ["Jean Luc\nKLEE"]
    for word in labels.PERSON_NOISE:
        if word == S.fold(word):
            assert grown(f"Jean Dupont {word.title()}", "Jean Dupont") == [], word


def test_fold_changes_only_the_published_letters():
    assert S.fold("ÉÀÇ ŞĞİı ŮŘ") == "eac sgii ur" and S.fold("øŐł’ß") == "øőł’ß".replace("ł", "l")
    assert all(len(S.fold(c)) == 1 for c in S.ACCENTED) and not S.CJK.search("かな한글") and S.CJK.search("漢")


def test_language_of_a_text(spark):
    cases = [
        ("Bonjour, ceci est un texte en francais avec plusieurs mots.", "fr"), ("Hello, this is a sample English text with some words.", "en"), ("Guten Tag, dies ist ein Beispieltext auf Deutsch.", "de"),
        ("こんにちは、これは日本語のテキストです。", "ja"), ("", "unknown"), ("   ", "unknown"), (None, "unknown"), ("12 34", "unknown"), ("xyzzy", "unknown"), ("Straße", "de"),
    ]
    rows = spark.createDataFrame([(t, w, None) for t, w in cases], "text string, wanted string, lang string")
    assert all(r["got"] == r["wanted"] for r in rows.select("wanted", language.detect_language(F.col("text")).alias("got")).collect())
    assert [r["lang"] for r in language.with_language(rows).collect()] == [None if w == "unknown" else w for _, w in cases]


def test_labels_for():
    table = {"CLIENT": {"fr": ["Client no", "N° client"], "en": ["Client No", "Sold to"]}, "NONE": {}}
    assert config.labels_for(table, "CLIENT") == ["Client no", "N° client", "Sold to"] and config.labels_for(table, "CLIENT", "en") == ["Client No", "Sold to"]
    assert config.labels_for(table, "CLIENT", "de") == config.labels_for(table, "OTHER") == config.labels_for(table, "NONE") == []


def test_words_end_as_in_python(spark):
    """Numbers of every kind are parts of words, joiners and connectors are not, and a long s is an s where case does not count."""
    texts = ["Service client½ x", "Service client² x", "Service client‿ x", "Service client‍ x", "ſervice client x", "Alpha Nord SA½", "Alpha Nord SA‿", "²Alpha Nord SA", "Nord Group Seattle"]
    found = D.prepared(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    for pattern in ("org_structure", "org_suffix"):
        d = next(x for x in D.UNIVERSAL if x.pattern == pattern)
        got = {r[0]: [(s["start"], s["text"]) for s in r[1]] for r in found.select("doc_id", D.spans_of(d)).collect()}
        group = d.group or 0
        assert got == {i: [(m.start(group), m[group]) for m in re.finditer(D.pattern_of(pattern), t)] for i, t in enumerate(texts)}
