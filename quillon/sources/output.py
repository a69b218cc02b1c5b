"""Sinks: renderings of masked documents as expressions, and a writer for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import word_lists as W
from quillon.functions.regex import let, to_java
from quillon.operators.vault import encrypt


#: Tokens in a block of running sums.
RUN = 64


def entity(s: Column) -> Column:
    """What the renderings show of a span: no original text."""
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("type"), F.element_at(s["metadata"], "placeholder").alias("placeholder"),
        F.round(s["score"], 3).alias("score"), s["recognizer"].alias("recognizer"),
    )


def to_json(source: str = "source") -> Column:
    return F.to_json(
        F.struct("anonymized_text", F.col("lang").alias("language"), F.transform("spans", entity).alias("entities"), "by_category", F.col(source).alias("source")), {"pretty": "true"}
    )


def to_jsonl() -> Column:
    """One entity a line."""
    return F.array_join(F.transform("spans", lambda s: F.concat(F.to_json(entity(s)), F.lit("\n"))), "")


def escaped(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_xml(source: str = "source") -> Column:
    attribute = lambda name, v: F.concat(F.lit(f' {name}="'), escaped(F.coalesce(v.cast("string"), F.lit("")), True), F.lit('"'))
    tag = lambda name, v: F.concat(F.lit(f"  <{name}>"), escaped(F.coalesce(v, F.lit(""))), F.lit(f"</{name}>\n"))
    rows = F.transform(
        "spans",
        lambda s: F.concat(F.lit("    <entity"), *[attribute(k, entity(s)[k]) for k in ("start", "end", "type", "placeholder", "score", "recognizer")], F.lit(" />\n")),
    )
    counts = F.transform(F.array_sort(F.map_entries("by_category")), lambda e: F.concat(F.lit("    <category"), attribute("name", e["key"]), F.lit(">"), e["value"].cast("string"), F.lit("</category>\n")))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<anonymizedDocument>\n'), tag("anonymizedText", F.col("anonymized_text")), tag("language", F.col("lang")), tag("source", F.col(source).cast("string")),
        F.lit("  <byCategory>\n"), F.array_join(counts, ""), F.lit("  </byCategory>\n  <entities>\n"), F.array_join(rows, ""), F.lit("  </entities>\n</anonymizedDocument>"),
    )


def conll_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start, token, tag: tokens between white space with B, I or O.

    A projection and an explode: each row's tokens meet its own spans, so ids may be null or repeated.
    """
    tokens = docs.where("text IS NOT NULL").select("doc_id", "spans", F.explode_outer(tokens_of(F.col("text"))).alias("t")).where("t IS NOT NULL")
    inside = F.get(F.filter("spans", lambda s: (s["start"] <= F.col("t.start")) & (F.col("t.start") < s["end"])), F.lit(0))
    tag = let(inside, lambda x: F.when(x.isNull(), F.lit("O")).otherwise(F.concat(F.when(x["start"] == F.col("t.start"), "B-").otherwise("I-"), x["entity_type"])))
    return tokens.select("doc_id", "t.line_no", "t.start", "t.token", tag.alias("tag"))


def tokens_of(text: Column, pattern: str = r"\S+") -> Column:
    """Array of (line_no, start, token) of a text's tokens, parts that match a pattern. Offsets come from sums over blocks of tokens and over the blocks, so a long text takes time in proportion."""
    pattern = to_java(pattern).pattern
    ints = "array<struct<at:int,line:int>>"
    last = lambda a, k: F.coalesce(F.get(a, F.size(a) - 1)[k], F.lit(0))

    def added(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.struct((last(done, "at") + x["at"]).alias("at"), (last(done, "line") + x["line"]).alias("line"))))

    def ends(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda b: F.aggregate(F.slice(steps, b * RUN + 1, RUN), F.array().cast(ints), added))
        before = lambda bs: F.aggregate(F.transform(bs, lambda b: F.struct(last(b, "at").alias("at"), last(b, "line").alias("line"))), F.array().cast(ints), added)
        moved = lambda bs, sums: F.transform(bs, lambda b, i: F.transform(b, lambda x: F.struct(
            (x["at"] + F.coalesce(F.get(sums, i - 1)["at"], F.lit(0))).alias("at"), (x["line"] + F.coalesce(F.get(sums, i - 1)["line"], F.lit(0))).alias("line")
        )))
        return let(blocks, lambda bs: let(before(bs), lambda sums: F.flatten(moved(bs, sums))))

    def placed(m: Column, gaps: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.struct((F.length(F.get(gaps, i)) + F.length(x)).alias("at"), (F.length(F.get(gaps, i)) - F.length(F.translate(F.get(gaps, i), "\n", ""))).alias("line")))
        token = lambda es: F.transform(m, lambda x, i: F.struct(F.get(es, i)["line"].alias("line_no"), (F.get(es, i)["at"] - F.length(x)).alias("start"), x.alias("token")))
        return F.when(F.size(m) > 0, let(steps, lambda st: let(ends(st), token)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda gaps: placed(m, gaps)))


def to_conll() -> Column:
    """Token and tag a line, an empty line at each line end; a token within a row sees the spans of its row.

    Texts without spans need no offsets. In others, a token's spans are looked for among those that begin in or reach into its block of RUN tokens.
    """
    pattern = r"\n|\S+"
    text = F.coalesce("text", F.lit(""))

    def plain(m: Column) -> Column:
        return F.transform(m, lambda x: F.when(x == "\n", F.lit("")).otherwise(F.concat(x, F.lit(" O"))))

    def tagged(t: Column, near: Column) -> Column:
        hit = F.get(F.filter(near, lambda s: (s["start"] <= t["start"]) & (t["start"] < s["end"])), F.lit(0))
        tag = let(hit, lambda h: F.when(h.isNull(), F.lit("O")).otherwise(F.concat(F.when(h["start"] == t["start"], "B-").otherwise("I-"), h["entity_type"])))
        return F.when(t["token"] == "\n", F.lit("")).otherwise(F.concat(t["token"], F.lit(" "), tag))

    def block(ts: Column, spans: Column) -> Column:
        near = F.filter(spans, lambda s: (s["start"] <= F.get(ts, F.size(ts) - 1)["start"]) & (F.get(ts, F.lit(0))["start"] < s["end"]))
        return let(near, lambda near: F.transform(ts, lambda t: tagged(t, near)))

    def blocks(ts: Column, spans: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(ts) - 1) / RUN).cast("int"))
        return F.flatten(F.transform(numbers, lambda b: let(F.slice(ts, b * RUN + 1, RUN), lambda part: block(part, spans))))

    # bound once: what stands behind the column would otherwise be computed for every token
    lines = let(F.col("spans"), lambda spans: F.when(F.size(spans) > 0, let(tokens_of(text, pattern), lambda ts: blocks(ts, spans))).otherwise(plain(F.regexp_extract_all(text, F.lit(to_java(pattern).pattern), F.lit(0)))))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def to_html(source: str = "source") -> Column:
    """The original with coloured spans and a legend."""
    colors = F.create_map(*[F.lit(x) for kv in W.HTML_COLORS.items() for x in kv])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(st: Column, s: Column) -> Column:
        name = F.concat(s["entity_type"], F.lit(" -> "), F.coalesce(F.element_at(s["metadata"], "placeholder"), F.lit("")))
        mark = F.concat(
            F.lit('<span style="background-color: '), F.coalesce(F.element_at(colors, s["entity_type"]), F.lit("#EEEEEE")), F.lit('; padding: 2px 4px; border-radius: 3px;" title="'), escaped(name, True), F.lit('">'), escaped(s["text"], True), F.lit("</span>"),
        )
        return F.struct(s["end"].alias("at"), F.concat(st["out"], F.array(escaped(F.substring("text", st["at"] + 1, s["start"] - st["at"]), True), mark)).alias("out"))

    body = F.aggregate("spans", state, step, lambda st: F.concat(F.array_join(st["out"], ""), escaped(F.substring("text", st["at"] + 1, F.length("text")), True)))
    legend = " ".join(f'<span style="background-color: {c};">{t}</span>' for t, c in sorted(W.HTML_COLORS.items()))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head><meta charset="UTF-8"><title>'), escaped(F.col(source).cast("string")), F.lit("</title></head>\n<body>\n<p>Language: <b>"), F.coalesce("lang", F.lit("")),
        F.lit("</b> | Entities: <b>"), F.size("spans").cast("string"), F.lit(f"</b></p>\n<div>{legend}</div>\n<pre>"), F.replace(body, F.lit("\n"), F.lit("<br>\n")), F.lit("</pre>\n</body>\n</html>\n"),
    )


RENDERINGS = {"txt": lambda: F.col("anonymized_text"), "json": to_json, "jsonl": to_jsonl, "xml": to_xml, "conll": to_conll, "html": to_html}


def write(masked: DataFrame, outbox: str, password: str, formats: tuple[str, ...] = tuple(RENDERINGS)) -> None:
    """One Parquet table a format below the outbox, (doc_id, content), the encrypted vault, and the counts of each document without any original."""
    for name in formats:
        masked.select("doc_id", RENDERINGS[name]().alias("content")).write.mode("overwrite").parquet(f"{outbox}/{name}")
    encrypt(masked, password).write.mode("overwrite").parquet(f"{outbox}/vault")
    meta(masked).write.mode("overwrite").parquet(f"{outbox}/meta")


def meta(masked: DataFrame) -> DataFrame:
    return masked.select("doc_id", "source", F.col("lang").alias("language"), F.size("spans").alias("n_spans"), "by_category", F.size("vault").alias("n_values"), F.length("text").alias("n_chars"), F.current_timestamp().alias("written_at"))


def redacted(event: Column, sensitive: tuple[str, ...] = ("text", "original", "original_text", "content", "value", "password", "key", "secret", "token", "vault", "placeholder_map")) -> Column:
    """An audit event (map) with sensitive fields blanked."""
    return F.transform_values(event, lambda k, v: F.when(F.lower(k).isin(*sensitive), F.lit("[REDACTED]")).otherwise(v))


__all__ = ["RENDERINGS", "conll_tokens", "entity", "let", "meta", "redacted", "write"]
