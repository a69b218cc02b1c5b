"""Queries of the engine itself, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import fixtures, oracle
from quillon.functions import checks
from quillon.functions.regex import matches
from quillon.operators import detectors as D
from quillon.operators import language, lists, reinject, vault
from quillon.operators import sequential as S
from quillon.operators.detect import IN_ORDER, Options, active_languages
from quillon.operators.mask import by_category, mask
from quillon.operators.resolve import resolve
from quillon.plans import anonymize as A
from quillon.sources import output
from quillon.sources.files import spread

#: Queries of detector families; SQL gives the same spans for those in IN_SQL.
FAMILIES = {
    "contact": "contact", "phone": "phone", "bank": "bank.context", "account": "bank.account", "fiscal": "fiscal", "address": "address", "place": "place", "person": "person.name", "birth": "person.birth",
    "organisation": "organisation", "reference": "reference.number", "client": "reference.client", "own_reference": "reference.own", "national_id": "national_id",
}
IN_SQL = ("contact", "phone", "bank", "fiscal", "address", "place", "person", "organisation", "reference", "national_id")
PASSWORD = "a demonstration password"
BARE = {"propagate": False, "expand": False, "protect": False}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their e-mail spans only, resolved: what several queries build on."""
    email = next(d for d in D.UNIVERSAL if d.tag == "EmailRegex")
    rows = D.prepared(_docs(spark, sf_dir)).withColumn("spans", D.spans_of(email)).drop(D.LOWER, D.DIGIT)
    return rows.withColumn("spans", resolve(F.col("spans")))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", A.normalized(F.col("text")).alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lines(_docs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "content")


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exploded(_emails(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text")


def page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode_outer(matches("html", D.pattern_of("email"))).alias("m")).where("m IS NOT NULL")
    return pages.select("page_id", F.col("m.start").cast("long").alias("start"), F.col("m.text").alias("text"))


def email_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_emails(spark, sf_dir)).select("doc_id", F.size("spans").cast("long").alias("n_spans"), "anonymized_text")


def spans_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _emails(spark, sf_dir).select("doc_id", F.explode_outer(by_category(F.col("spans"))).alias("entity_type", "n")).where("entity_type IS NOT NULL")
    return counts.groupBy("entity_type").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_docs"))


def vault_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.rows(mask(_emails(spark, sf_dir)))


def opaque_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.rows(mask(_emails(spark, sf_dir), opaque=True))


def vault_encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.rows(vault.decrypt(vault.encrypt(mask(_emails(spark, sf_dir)), PASSWORD), PASSWORD))


def reinject_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask(_emails(spark, sf_dir), clean_orphans=False)
    answers = masked.select("doc_id", F.col("anonymized_text").alias("content"))
    return reinject.reinject(answers, masked.select("doc_id", "vault")).select("doc_id", F.col("restored").alias("text"))


def reinject_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in JSON and XML that quote each document's first placeholder."""
    masked = mask(_emails(spark, sf_dir)).where(F.size("vault") > 0)
    name = F.get("vault", F.lit(0))["placeholder"]
    answers = masked.select("doc_id", F.explode(F.array(F.to_json(F.struct(F.array(name).alias("to"), F.lit(1).alias("n"))), F.concat(F.lit('<a to="'), name, F.lit('">'), name, F.lit("</a>")))).alias("content"))
    return reinject.reinject(answers, masked.select("doc_id", "vault"))


def conll_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = output.conll_tokens(_emails(spark, sf_dir))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), "token", "tag")


def entities_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask(_emails(spark, sf_dir)).where(F.size("spans") > 0).select("doc_id", output.to_jsonl().alias("content"))


def renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask(_emails(spark, sf_dir))
    return masked.select("doc_id", *[f().alias(k) for k, f in output.RENDERINGS.items()])


def iban_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check over numbers made of customer keys, letters included."""
    made = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", made.alias("iban")).withColumn("valid", checks.iban_valid(F.col("iban")))


def rib_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "3"), F.lit("00550"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit("Z"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", made.alias("rib")).withColumn("valid", checks.rib_valid(F.col("rib")))


def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", language.detect_language(F.col("text")).alias("language"))


def languages_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.prepared(fixtures.corpus(spark, sf_dir))
    return rows.select("doc_id", F.explode_outer(active_languages("lang")).alias("language"))


#: Lists of the deny-list query: kind, entries.
DENIED = (("organizations", ("Fabrik Nord", "Northwind Tools", "Werkzeug-Nord")), ("organizations_loose", ("Fabrik Nord", "Northwind Tools", "Werkzeug-Nord")), ("people", ("Julien Marchand", "Karl Lindner")), ("places", ("Hamburg", "Paris")), ("singleton", ("Northwind",)), ("singleton_loose", ("Northwind",)))


def denylist_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.concat(*[getattr(lists, kind)("text", entries) for kind, entries in DENIED])
    return A.exploded(fixtures.corpus(spark, sf_dir).withColumn("spans", found))


def dictionary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First names and makers by pattern, and the same names by a join, the way for lists of any size."""
    from quillon.sources.files import dictionary_spans as joined

    docs = fixtures.corpus(spark, sf_dir)
    names = ("Julien", "Karl", "John")
    by_pattern = F.concat(lists.first_names("text", names, "fr"), lists.makers("text", ("Northwind Tools",)), lists.cities("text", ("Hamburg",), "de"), lists.initial_surname("text", ("Marchand",)))
    one = A.exploded(docs.withColumn("spans", by_pattern)).drop("seq")
    entries = spark.createDataFrame([(n,) for n in (*names, "northwind tools")], "entry string")
    return one.unionByName(joined(docs, entries, "PERSON", "FirstnameDict_join", 0.6))


def _family(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """What the family's patterns find; rules that run in order have queries of their own."""
        return A.exploded(A.spans(fixtures.corpus(spark, sf_dir), Options(families=(family,), **BARE), refined=False))

    return run


def optional_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors that are defined but not part of detection."""
    rows = D.prepared(fixtures.corpus(spark, sf_dir))
    return A.exploded(rows.withColumn("spans", F.flatten(F.array(*[D.spans_of(d) for d in D.OPTIONAL]))))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.corpus(spark, sf_dir).withColumn("spans", F.array().cast(D.SPANS))
    return A.exploded(S.revised(rows, lambda t, s, k: S.table_columns(t)))


def sequential_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.corpus(spark, sf_dir).withColumn("spans", F.array().cast(D.SPANS))
    return A.exploded(S.revised(rows, lambda t, s, k: [x for rule, _, _ in IN_ORDER for x in rule(t)]))


def _after(rule, families: tuple[str, ...] = ("contact", "bank", "person", "organisation")) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = A.spans(fixtures.corpus(spark, sf_dir), Options(families=families, organizations=("Fabrik Nord",), people=("Karl Lindner",), **BARE))
        return A.exploded(S.revised(raw, rule))

    return run


def table_body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected lines of tables as spans."""
    rows = fixtures.corpus(spark, sf_dir).withColumn("spans", F.array().cast(D.SPANS))
    as_spans = lambda t, s, k: [S.Span(a, b, "TABLE", t[a:b], 1.0, "TableBody", {}) for a, b in S.table_body(t, fixtures.LEXICON)]
    return A.exploded(S.revised(rows, as_spans))


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = A.spans(fixtures.corpus(spark, sf_dir), Options(families=("contact", "bank", "person"), **BARE))
    return A.exploded(raw.withColumn("spans", resolve(F.col("spans"))))


def anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.anonymize(fixtures.corpus(spark, sf_dir), Options(lexicon=fixtures.LEXICON))
    return done.select("doc_id", "lang", F.size("spans").alias("n_spans"), "anonymized_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        normalize_text, document_lines, email_spans, page_emails, email_mask, spans_by_category, vault_entries, opaque_placeholders, vault_encrypt_roundtrip, reinject_roundtrip,
        reinject_trees, conll_tokens, entities_jsonl, renderings, iban_checksum, rib_checksum, detected_language, languages_by_marker, denylist_spans, dictionary_spans, optional_spans, table_columns, sequential_spans, table_body_lines, resolved_spans, anonymize,
    )
    return {f.__name__: f for f in plain} | {f"{k}_detectors": _family(family) for k, family in FAMILIES.items()} | {
        "propagated_spans": _after(lambda t, s, k: S.propagated(t, s)),
        "expanded_spans": _after(lambda t, s, k: S.persons_on_line(t, S.organisations_on_line(t, s))),
        "allowlist_filtered": _after(lambda t, s, k: S.allowed(t, s, fixtures.LEXICON, (r"\d{2}/\d{2}/\d{4}",))),
        "table_body_filtered": _after(lambda t, s, k: S.outside_tables(t, s, fixtures.LEXICON)),
    }


EMAIL_SQL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+(?:\n[a-zA-Z0-9.\-]+)?\.[a-zA-Z]{2,}\b"


def _match_sql(table: str, key: str, text: str, pattern: str) -> str:
    """Common table expressions `found`: key, i, start, m, and per row the pieces between matches."""
    return f"""pieces AS (
  SELECT {key}, {text} AS t, regexp_extract_all({text}, '{pattern}') AS ms, regexp_split_to_array({text}, '{pattern}') AS gs FROM {table} WHERE {text} IS NOT NULL
), hits AS (SELECT {key}, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM pieces WHERE len(ms) > 0
), found AS (
  SELECT {key}, i, ms[i] AS m,
    CAST(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM hits)"""


_EMAILS = f"WITH {_match_sql('documents', 'doc_id', 'text', EMAIL_SQL)}"
_VAULT = f"""{_EMAILS}, firsts AS (SELECT doc_id, m, min(start) AS start FROM found GROUP BY doc_id, m
), vault AS (SELECT doc_id, m AS original, '[EMAIL_' || row_number() OVER (PARTITION BY doc_id ORDER BY start) || ']' AS placeholder FROM firsts)"""

#: The clean-up of single capitals without lookahead.
_TRAILING = r"(\[[A-Z_]+(?:_\d+)?\])\s+([A-Z])([\s,;:\)\]\.])"
_ADJACENT = r"(\[[A-Z_]+(?:_\d+)?\])([A-Z])(\s|$|[^A-Za-z])"


def oracle_sql() -> dict[str, str]:
    spaces = r"[\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    lines = r"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), numbered AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM parts
), lines AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, ls[i] AS content, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start FROM numbered)"""
    entity = "'{\"start\":' || start || ',\"end\":' || (start + length(m)) || ',\"type\":\"EMAIL\",\"placeholder\":\"' || placeholder || '\",\"score\":0.95,\"recognizer\":\"EmailRegex\"}' || chr(10)"
    tokens = f"""{_EMAILS}, {lines[5:]}, words AS (
  SELECT doc_id, line_no, start AS line_start, regexp_extract_all(content, '\\S+') AS ms, regexp_split_to_array(content, '\\S+') AS gs FROM lines
), each AS (SELECT doc_id, line_no, line_start, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM words WHERE len(ms) > 0
), token AS (SELECT doc_id, line_no, ms[i] AS token, CAST(line_start + list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM each)
SELECT t.doc_id, t.line_no, t.start, t.token, CASE WHEN f.start IS NULL THEN 'O' WHEN f.start = t.start THEN 'B-EMAIL' ELSE 'I-EMAIL' END AS tag
FROM token t LEFT JOIN found f ON f.doc_id = t.doc_id AND f.start <= t.start AND t.start < f.start + length(f.m)"""
    digits = "regexp_replace('WEST' || lpad(c_custkey::VARCHAR, 14, '0') || 'GB' || lpad((c_custkey % 100)::VARCHAR, 2, '0'), '[^0-9A-Z]', '', 'g')"
    for letter, number in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", range(10, 36)):
        if letter in "WESTGB":
            digits = f"replace({digits}, '{letter}', '{number}')"
    stops = lambda k: f"2 * len(list_filter(ws, lambda w: list_contains([{', '.join(map(oracle.text, language.STOP_WORDS[k]))}], w)))" + (f" + length(regexp_replace(low, '[^{language.LETTERS[k]}]', '', 'g'))" if language.LETTERS[k] else "")
    spoken = rf"""WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents
), found AS (SELECT doc_id, low, regexp_extract_all(low, '\p{{L}}+') AS ws FROM low
), scored AS (SELECT doc_id, {stops('fr')} AS fr, {stops('en')} AS en, {stops('de')} AS de, length(regexp_replace(low, '[^{language.JAPANESE[1:-1]}]', '', 'g')) AS ja, length(regexp_replace(low, '\P{{L}}', '', 'g')) AS letters FROM found)
SELECT doc_id, CASE WHEN ja > 0 AND 2 * ja >= letters THEN 'ja' WHEN greatest(fr, en, de) = 0 THEN 'unknown' WHEN fr >= en AND fr >= de THEN 'fr' WHEN en >= de THEN 'en' ELSE 'de' END AS language FROM scored"""
    return {f"{k}_detectors": oracle.family(FAMILIES[k]) for k in IN_SQL} | {
        "denylist_spans": oracle.listed([(lists.alternation(entries, **oracle.LISTS[kind][3]), *oracle.LISTS[kind][:3]) for kind, entries in DENIED]),
        "dictionary_spans": oracle.dictionaries(
            ("Julien", "Karl", "John", "northwind tools"),
            [(lists.alternation(("Julien", "Karl", "John"), accents=True), "PERSON", "FirstnameDict_fr", 0.6), (lists.alternation(("Northwind Tools",), accents=True), "ORGANIZATION", "AutomotiveOemDict", 0.85), (lists.alternation(("Hamburg",), accents=True), "LOCATION", "CityDict_de", 0.7)],
            ("Marchand",),
        ),
        "optional_spans": oracle.union([(D.pattern_of(d.pattern), d.group, d.entity, d.tag, d.score) for d in D.OPTIONAL]),
        "languages_by_marker": f"WITH {oracle.languages()} SELECT doc_id, language FROM spoken",
        "detected_language": spoken,
        "normalize_text": rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\x{{FEFF}}', ''), '{spaces}', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g') AS text FROM documents",
        "document_lines": f'{lines} SELECT doc_id, line_no, start, start + length(content) AS "end", content FROM lines',
        "email_spans": f'{_EMAILS} SELECT doc_id, start, start + length(m) AS "end", m AS text FROM found',
        "page_emails": f"WITH {_match_sql('pages', 'page_id', 'html', EMAIL_SQL)} SELECT page_id, start, m AS text FROM found",
        "email_mask": f"""{_VAULT}, put AS (SELECT f.doc_id, list(v.placeholder ORDER BY f.i) AS ps, count(*) AS n FROM found f JOIN vault v ON f.doc_id = v.doc_id AND f.m = v.original GROUP BY f.doc_id
), filled AS (
  SELECT d.doc_id, coalesce(p.n, 0) AS n_spans, CASE WHEN p.n IS NULL THEN coalesce(d.text, '') ELSE array_to_string(list_transform(range(1, len(g.gs) + 1), lambda k: g.gs[k] || coalesce(p.ps[k], '')), '') END AS t
  FROM documents d LEFT JOIN put p ON d.doc_id = p.doc_id LEFT JOIN pieces g ON d.doc_id = g.doc_id)
SELECT doc_id, n_spans, regexp_replace(regexp_replace(t, '{_TRAILING}', '\\1\\3', 'g'), '{_ADJACENT}', '\\1\\3', 'g') AS anonymized_text FROM filled""",
        "spans_by_category": f"{_EMAILS} SELECT 'EMAIL' AS entity_type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM found HAVING count(*) > 0",
        "vault_entries": f"{_VAULT} SELECT doc_id, placeholder, original FROM vault",
        "vault_encrypt_roundtrip": f"{_VAULT} SELECT doc_id, placeholder, original FROM vault",
        "opaque_placeholders": f"{_VAULT} SELECT doc_id, '[EMAIL_' || substr(sha256(original), 1, 4) || ']' AS placeholder, original FROM vault",
        "reinject_roundtrip": "SELECT doc_id, text FROM documents",
        "entities_jsonl": f"{_VAULT} SELECT f.doc_id, string_agg({entity}, '' ORDER BY start) AS content FROM found f JOIN vault v ON f.doc_id = v.doc_id AND f.m = v.original GROUP BY f.doc_id",
        "conll_tokens": tokens,
        "iban_checksum": f"""SELECT c_custkey, 'GB' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || 'WEST' || lpad(c_custkey::VARCHAR, 14, '0') AS iban, CAST({digits} AS HUGEINT) % 97 = 1 AS valid FROM customer""",
        "rib_checksum": """SELECT c_custkey, rib, (CAST(substr(rib, 1, 5) AS BIGINT) * 89 + CAST(substr(rib, 6, 5) AS BIGINT) * 15 + CAST(replace(substr(rib, 11, 11), 'Z', '9') AS BIGINT) * 3 + CAST(substr(rib, 22, 2) AS BIGINT)) % 97 = 0 AS valid
FROM (SELECT c_custkey, lpad((c_custkey % 100000)::VARCHAR, 5, '3') || '00550' || lpad(c_custkey::VARCHAR, 10, '0') || 'Z' || lpad((c_custkey % 97)::VARCHAR, 2, '0') AS rib FROM customer)""",
    }
