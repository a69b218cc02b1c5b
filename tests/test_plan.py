"""Resolution, masking, vault, reinjection, renderings, sources, streams."""

import json
import random
import re
import time
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quillon import fixtures
from quillon.operators import mask as M
from quillon.operators import reinject, vault
from quillon.operators.detect import Options
from quillon.operators.resolve import BY_TAG, CERTIFIED, resolve
from quillon.operators.spans import SPANS
from quillon.plans import anonymize as A
from quillon.sources import config, files, output
from quillon.streaming import stream

NAMES = ("start", "end", "entity_type", "text", "score", "recognizer")
ROWS = "id int, text string, spans " + SPANS


def span(text, a, b, score=0.5, tag="X", kind="T"):
    return (a, b, kind, text[a:b], score, tag, {})


def model(spans):
    """The same choice in plain Python."""
    clean = []
    for a, b, kind, text, score, tag, _ in spans:
        t = text.strip()
        if t:
            a += len(text) - len(text.lstrip())
            clean.append((a, a + len(t), kind, t, score, tag))
    order = sorted(clean, key=lambda s: (s[5] not in CERTIFIED, s[0] - s[1], -s[4], -BY_TAG.get(s[5], 0), s[0]))
    taken = []
    for a, b, kind, text, score, tag in order:
        free = [i for i in range(a, b) if not any(x[5] in CERTIFIED and x[0] <= i < x[1] for x in taken)]
        runs, start = [], None
        for i in free:
            if start is None or i != last + 1:
                start = i
                runs.append([i, i + 1])
            runs[-1][1] = i + 1
            last = i
        if not runs:
            continue
        lo, hi = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
        if not any(lo < x[1] and x[0] < hi for x in taken):
            taken.append((lo, hi, kind, text[lo - a : hi - a], score, tag))
    return sorted(taken)


def test_resolution_equals_the_model(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab cd") for _ in range(200))
    rows = []
    for i in range(120):
        spans = []
        for _ in range(rng.randrange(0, 25)):
            a = rng.randrange(0, 190)
            spans.append(span(text, a, a + rng.randrange(1, 20), rng.choice([0.5, 0.7, 0.9]), rng.choice(["IbanRegex", "EmailRegex", "UrlRegex", "X", "OrgSingleton"])))
        rows.append((i, text, spans))
    got = spark.createDataFrame(rows, ROWS).select("id", resolve(F.col("spans")).alias("s")).collect()
    for r in got:
        assert [tuple(s[n] for n in NAMES) for s in r["s"]] == model(rows[r["id"]][2]), r["id"]


def test_resolution_order(spark):
    t = "x" * 40
    rows = [(1, t, [span(t, 0, 20), span(t, 5, 10, 0.9)]), (2, t, [span(t, 0, 5), span(t, 0, 5, 0.9)]), (3, t, [span(t, 0, 5, 0.5, "GLiNER"), span(t, 0, 5, 0.5, "NameCommaRegex")]), (4, t, None), (5, t, [])]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(rows, ROWS).select("id", resolve(F.col("spans")).alias("s")).collect()}
    assert got[1][0]["end"] == 20 and got[2][0]["score"] == 0.9 and got[3][0]["recognizer"] == "NameCommaRegex" and got[4] == [] and got[5] == []


@pytest.fixture(scope="module")
def masked(spark):
    t = "Ann Bob Ann Acme acme x@y.z"
    spans = [span(t, 0, 3, kind="PERSON"), span(t, 4, 7, kind="PERSON"), span(t, 8, 11, kind="ORGANIZATION"), span(t, 12, 16, kind="ORG_SINGLETON"), span(t, 17, 21, kind="ORG_SINGLETON"), span(t, 22, 27, kind="EMAIL")]
    rows = spark.createDataFrame([(1, t, spans, "en", "s<1>"), (2, None, [], None, None)], "doc_id int, text string, spans " + SPANS + ", lang string, source string")
    return M.mask(rows).cache()


def test_mask(masked):
    one, two = masked.orderBy("doc_id").collect()
    assert one["anonymized_text"] == "[CONTACT_1] [CONTACT_2] [CONTACT_1] [CLIENT_NAME] [CLIENT_NAME] [EMAIL_1]"
    assert one["by_category"] == {"EMAIL": 1, "ORGANIZATION": 1, "ORG_SINGLETON": 2, "PERSON": 2} and two["anonymized_text"] == "" and two["vault"] == []


def test_opaque_and_orphans(spark):
    t = "Ann M, Bob"
    rows = spark.createDataFrame([(1, t, [span(t, 0, 3, kind="PERSON"), span(t, 7, 10, kind="PERSON")])], ROWS)
    assert M.mask(rows).first()["anonymized_text"] == "[CONTACT_1], [CONTACT_2]"
    assert M.mask(rows, clean_orphans=False).first()["anonymized_text"] == "[CONTACT_1] M, [CONTACT_2]"
    import hashlib

    assert M.mask(rows, opaque=True).first()["vault"][0]["placeholder"] == f"[CONTACT_{hashlib.sha256(b'Ann').hexdigest()[:4]}]"


def test_vault(spark, masked):
    sealed = vault.encrypt(masked, "a password of some length").cache()
    opened = {r["doc_id"]: r["vault"] for r in vault.decrypt(sealed, "a password of some length").collect()}
    assert [e["original"] for e in opened[1]] == ["Ann", "Bob", "Acme", "acme", "x@y.z"]
    assert b"Ann" not in bytes(sealed.where("doc_id = 1").first()["payload"])
    with pytest.raises(Exception, match="wrong password"):
        vault.decrypt(sealed, "another password, as long").collect()
    with pytest.raises(vault.VaultError):
        vault.encrypt(masked, "short")


@pytest.mark.parametrize(
    "content,wanted",
    [
        ("Dear [CONTACT_1] and [NOPE_9]", "Dear Ann and [NOPE_9]"), ('{"a": ["[EMAIL_1]", 1], "[EMAIL_1]": null}', json.dumps({"a": ["x@y.z", 1], "[EMAIL_1]": None}, indent=2)),
        ("EMAIL_1", "x@y.z"), ("see EMAIL_1.", "see x@y.z."), ("[CONTACT_1] began", "Ann began"), ("", ""), (None, None),
    ],
)
def test_reinjection(spark, masked, content, wanted):
    answers = spark.createDataFrame([(1, content)], "doc_id int, content string")
    assert reinject.reinject(answers, masked.select("doc_id", "vault")).first()["restored"] == wanted


def test_reinjection_of_xml(spark, masked):
    answers = spark.createDataFrame([(1, '<a k="[EMAIL_1]">[CONTACT_2]<b/>[CONTACT_1]</a>')], "doc_id int, content string")
    root = ET.fromstring(reinject.reinject(answers, masked.select("doc_id", "vault")).first()["restored"])
    assert root.text == "Bob" and root[0].tail == "Ann" and root.get("k") == "x@y.z"


def test_renderings(masked):
    row = masked.where("doc_id = 1").select(*[f().alias(k) for k, f in output.RENDERINGS.items()]).first()
    assert json.loads(row["json"])["entities"][0]["placeholder"] == "[CONTACT_1]" and len(row["jsonl"].splitlines()) == 6
    root = ET.fromstring(row["xml"].split("\n", 1)[1])
    assert len(root.find("entities")) == 6 and root.find("source").text == "s<1>"
    assert row["conll"].splitlines()[0] == "Ann B-PERSON" and "&lt;1&gt;" in row["html"] and "Ann" not in row["json"]


def test_conll_rendering_of_long_texts(spark):
    """Against a plain model: tokens that begin before a span, end after it, or touch another; offsets beyond the basic plane; 20,000 words in time."""
    long = " ".join(f"w{i}" if i % 7 else f"\n😀x{i}" for i in range(20_000))
    cut = lambda t, *at: [(a, b, "EMAIL", t[a:b], 1.0, "EmailRegex", {}) for a, b in at]
    short = "ab cd\n\n efgh-ij kl\n"
    rows = [(1, long, cut(long, *[(i, i + 11) for i in range(3, len(long) - 20, 997)])), (2, short, cut(short, (1, 4), (8, 12), (12, 13), (17, 18))), (3, short, []), (4, "", []), (5, None, []), (6, "a", None), (7, "x\n", cut("x\n", (0, 1)))]
    schema = "doc_id long, text string, spans array<struct<start:int,end:int,entity_type:string,text:string,score:double,recognizer:string,metadata:map<string,string>>>"

    def model(text, spans):
        lines = []
        for m in re.finditer(r"\n|\S+", text or ""):
            hit = next((s for s in spans or [] if s[0] <= m.start() < s[1]), None)
            lines.append("" if m[0] == "\n" else f"{m[0]} " + ("O" if hit is None else ("B-" if hit[0] == m.start() else "I-") + hit[2]))
        return "\n".join(lines) + "\n"

    began = time.time()
    got = dict(spark.createDataFrame(rows, schema).select("doc_id", output.to_conll()).collect())
    assert got == {i: model(t, s) for i, t, s in rows}
    assert time.time() - began < 60


def test_write_and_read(spark, masked, tmp_path):
    output.write(masked, str(tmp_path), "a password of some length", ("txt", "jsonl"))
    assert spark.read.parquet(f"{tmp_path}/meta").where("doc_id = 1").first()["n_values"] == 5
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("é".encode())
    (tmp_path / "in" / "b.txt").write_bytes("é".encode("latin-1"))
    assert {(r["text"], r["encoding"]) for r in files.read_texts(spark, str(tmp_path / "in")).collect()} == {("é", "utf-8"), ("é", "latin-1")}


def test_config(tmp_path):
    pytest.importorskip("yaml")
    for path, body in {"base/deny_lists/people.yaml": "- A B", "profiles/p/deny_lists/people.yaml": "- C D", "profiles/p/allow_lists/x.yaml": "lexicon:\n  fr: [mot]\nrules: ['\\d+']"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    c = config.load(tmp_path / "base", "p", profiles_dir=tmp_path / "profiles")
    o = config.options(c)
    assert o.people == ("A B", "C D") and "mot" in o.lexicon and r"\d+" in o.allow_patterns
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "base", "none", profiles_dir=tmp_path / "profiles")


def test_normalisation_and_lines(spark):
    rows = spark.createDataFrame([(1, "﻿a  b\t\tc\n\nd"), (2, None)], "doc_id int, text string")
    assert rows.select(A.normalized(F.col("text"))).first()[0] == "a b c\n\nd"
    assert [(r["start"], r["content"]) for r in A.lines(rows).orderBy("line_no").collect()] == [(0, "﻿a  b\t\tc"), (9, ""), (10, "d")]


def test_whole_run_and_stream(spark, tmp_path):
    docs = fixtures.documents(spark)
    o = Options(families=("contact", "bank"), lexicon=fixtures.LEXICON)
    done = {r["doc_id"]: r for r in A.anonymize(docs, o).collect()}
    assert "contact@fabrik-nord.example" not in done[-1]["anonymized_text"] and "[IBAN_1]" in done[-1]["anonymized_text"]
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.start(stream.read(spark, str(tmp_path / "in")), lambda df, n: seen.extend(df.select("doc_id", "anonymized_text").collect()), str(tmp_path / "state"), o)
    q.awaitTermination(120)
    assert {r["doc_id"]: r["anonymized_text"] for r in seen} == {k: v["anonymized_text"] for k, v in done.items()}


def test_dictionary_spans_of_long_entries(spark):
    name = "Ministry of the Interior and of Sport"
    docs = spark.createDataFrame([(1, f"The {name} wrote."), (2, "Sport of the Ministry")], "doc_id long, text string")
    entries = spark.createDataFrame([(name,), ("Sport",)], "entry string")
    got = [(r["doc_id"], r["start"], r["text"]) for r in files.dictionary_spans(docs, entries, "ORG", "LIST", 0.5).collect()]
    assert sorted(got) == [(1, 4, name), (1, 4 + name.index("Sport"), "Sport"), (2, 0, "Sport")]
    assert files.dictionary_spans(docs, entries.limit(0), "ORG", "LIST", 0.5).count() == 0
