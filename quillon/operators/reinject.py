"""Reinjection: originals put back into answers that hold placeholders, whether text, JSON or XML."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import word_lists as W
from quillon.functions.regex import to_java
from quillon.operators.vault import original_of


def restored(text: Column, vault: Column) -> Column:
    """Native form for plain text: bracketed placeholders first; then a text that is one bare placeholder; then bare ones inside. Unknown ones stay."""

    def replaced(t: Column, pattern: str, wrap: bool) -> Column:
        p = to_java(pattern).pattern
        marks = F.regexp_extract_all(t, F.lit(p), F.lit(0))
        gaps = F.split(t, p, -1)
        name = lambda m: F.concat(F.lit("["), m, F.lit("]")) if wrap else m
        put = F.transform(marks, lambda m: F.coalesce(original_of(vault, name(m)), m))
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(put, i), F.lit("")))), "")

    first = replaced(text, W.PLACEHOLDER, False)
    return replaced(first, W.PLACEHOLDER_BARE_INLINE, True)


def _lookup(vault: dict[str, str]):
    put = lambda m: vault.get(m[0], m[0])
    bare = lambda m: vault.get(f"[{m[0]}]", m[0])
    return lambda s: re.sub(W.PLACEHOLDER_BARE_INLINE, bare, re.sub(W.PLACEHOLDER, put, s))


def restore_tree(data, put):
    """Strings of a JSON tree, keys left alone."""
    match data:
        case str():
            return put(data)
        case dict():
            return {k: restore_tree(v, put) for k, v in data.items()}
        case list() | tuple():
            return [restore_tree(v, put) for v in data]
    return data


def restore_json(content: str, vault: dict[str, str]) -> str:
    return json.dumps(restore_tree(json.loads(content), _lookup(vault)), ensure_ascii=False, indent=2)


def restore_xml(content: str, vault: dict[str, str]) -> str:
    """Texts, tails and attributes."""
    put, root = _lookup(vault), ET.fromstring(content)
    for e in root.iter():
        e.text, e.tail = (put(x) if x else x for x in (e.text, e.tail))
        e.attrib.update({k: put(v) for k, v in e.attrib.items()})
    return ET.tostring(root, encoding="unicode")


def restore(content: str, vault: dict[str, str]) -> str:
    """By the first character: JSON, XML or text. What does not parse is text, so a masked text may begin with a placeholder."""
    try:
        match content.lstrip()[:1]:
            case "{" | "[":
                return restore_json(content, vault)
            case "<":
                return restore_xml(content, vault)
    except (ValueError, ET.ParseError):
        pass
    return _lookup(vault)(content)


def reinject(answers: DataFrame, vaults: DataFrame) -> DataFrame:
    """Adds `restored` to answers(doc_id, content) by the vault of their document: plain texts natively, trees by an Arrow UDF."""

    @F.arrow_udf("string")
    def trees(contents: pa.Array, entries: pa.Array) -> pa.Array:
        return pa.array([None if c is None else restore(c, {e["placeholder"]: e["original"] for e in v or ()}) for c, v in zip(contents.to_pylist(), entries.to_pylist())], pa.string())

    joined = answers.join(vaults.select("doc_id", "vault"), "doc_id", "left").withColumn("vault", F.coalesce("vault", F.array().cast("array<struct<placeholder:string,original:string>>")))
    is_tree = F.regexp_like(F.col("content"), F.lit(r"^\s*[\{\[<]"))
    return joined.withColumn("restored", F.when(is_tree, trees("content", "vault")).otherwise(restored(F.col("content"), F.col("vault")))).drop("vault")
