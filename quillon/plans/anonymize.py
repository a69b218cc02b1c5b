"""The whole run as one plan: normalise, detect, refine, resolve, mask. Spans stay in an array per row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import word_lists as W
from quillon.functions.regex import let, to_java
from quillon.operators.detect import Options, active_languages, detect, refine
from quillon.operators.detectors import DIGIT, LOWER, prepared
from quillon.operators.mask import mask
from quillon.operators.resolve import resolve


def without_pipes(line: Column, rounds: int = 6) -> Column:
    """A line without lone pipes between words; table lines, which begin with a pipe, stay. A run of n pipes takes about log2(n) rounds."""
    out = line
    for _ in range(rounds):
        out = F.regexp_replace(out, F.lit(_numbered(W.PIPE_NOISE)), F.lit("$1$2"))
    return F.when(F.startswith(F.ltrim(line), F.lit("|")), line).otherwise(out)


def _numbered(pattern: str) -> str:
    """Java syntax with plain groups kept: the small patterns have no named ones."""
    return "(?U)" + pattern


def normalized(text: Column, spaces: bool = True, pipes: bool = False) -> Column:
    """Without byte order mark, odd white space as a space, pipe noise removed if asked, blanks collapsed."""
    out = F.regexp_replace(text, F.lit(to_java(W.BOM).pattern), F.lit(""))
    out = F.regexp_replace(out, F.lit(to_java(W.ODD_SPACE).pattern), F.lit(" "))
    if pipes:
        out = F.array_join(F.transform(F.split(out, "\n", -1), without_pipes), "\n")
    return F.regexp_replace(out, F.lit(to_java(W.SPACES).pattern), F.lit(" ")) if spaces else out


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start, end, content: every line of every text with its offsets."""

    def placed(parts: Column) -> Column:
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,content:string>>").alias("out"))
        step = lambda st, p: F.struct(
            (st["at"] + F.length(p) + 1).alias("at"), F.concat(st["out"], F.array(F.struct(st["at"].alias("start"), (st["at"] + F.length(p)).alias("end"), p.alias("content")))).alias("out")
        )
        return F.aggregate(parts, state, step, lambda st: st["out"])

    rows = docs.where("text IS NOT NULL").select("doc_id", F.posexplode_outer(let(F.split("text", "\n", -1), placed)).alias("line_no", "l"))
    return rows.select("doc_id", "line_no", "l.start", "l.end", "l.content")


def spans(docs: DataFrame, o: Options = Options(), refined: bool = True) -> DataFrame:
    """Adds languages and spans (before resolution) to documents."""
    found = prepared(docs).withColumn("languages", active_languages("lang", o.primary_language))
    raw = found.withColumn("spans", detect(F.col("languages"), o)).drop(LOWER, DIGIT)
    return refine(raw, o) if refined else raw


def anonymize(docs: DataFrame, o: Options = Options(), spaces: bool = True, pipes: bool = False) -> DataFrame:
    """documents(doc_id, text, lang, ...) with text normalised, and languages, spans, vault, anonymized_text, by_category added.

    A null text has no spans and an empty result; numbering restarts in every row.
    """
    clean = docs.withColumn("text", normalized(F.col("text"), spaces, pipes))
    resolved = spans(clean, o).withColumn("spans", resolve(F.col("spans")))
    return mask(resolved, opaque=o.opaque, clean_orphans=o.clean_orphans)


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, seq and the fields of each span."""
    # the plain form lets the optimizer test the size of `spans` beside the scan, which would compute them twice
    rows = docs.select("doc_id", F.posexplode_outer("spans").alias("seq", "s")).where("s IS NOT NULL")
    return rows.select("doc_id", "seq", "s.start", "s.end", "s.entity_type", "s.text", "s.score", "s.recognizer")
