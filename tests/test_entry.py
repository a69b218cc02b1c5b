"""The entry module, with and without the optional subpackage, and queries against their SQL."""

import importlib
import os
import sys

import pytest

import __spark_entry__ as entry
from quillon.queries import IN_SQL

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
FAST = ("normalize_text", "document_lines", "email_spans", "email_mask", "vault_entries", "opaque_placeholders", "spans_by_category", "reinject_roundtrip", "entities_jsonl", "iban_checksum", "rib_checksum", "conll_tokens", "detected_language", "languages_by_marker", "denylist_spans", "dictionary_spans", "optional_spans", *(f"{k}_detectors" for k in IN_SQL))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    plain = lambda x: round(float(x), 9) if isinstance(x, float) else x
    rows = lambda d: sorted(str(tuple(map(plain, r))) for r in d[columns].itertuples(index=False, name=None))
    assert columns == sorted(want.columns) and rows(got) == rows(want)


def test_entry_imports_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quillon.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillon.llm", None)
    bare = importlib.import_module("__spark_entry__")
    assert "anonymize" in bare.queries() and not any(k.startswith("op") and k[2].isdigit() for k in bare.queries()) and "pipeline" not in bare.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
