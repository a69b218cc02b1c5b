"""The span type and its primitives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,entity_type:string,text:string,score:double,recognizer:string,metadata:map<string,string>>"
SPANS = f"array<{SPAN}>"

NO_META = "map<string,string>"


def empty() -> Column:
    return F.array().cast(SPANS)


def make(match: Column, entity: str, tag: str, score: Column | float, metadata: dict[str, str] | None = None) -> Column:
    """A span from a match struct (start, end, text)."""
    meta = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.create_map().cast(NO_META)
    value = score if isinstance(score, Column) else F.lit(float(score))
    return F.struct(
        match["start"].alias("start"), match["end"].alias("end"), F.lit(entity).alias("entity_type"), match["text"].alias("text"),
        value.cast("double").alias("score"), F.lit(tag).alias("recognizer"), meta.cast(NO_META).alias("metadata"),
    )


def valid(s: Column) -> Column:
    """start >= 0, end > start, 0 <= score <= 1, a type."""
    return (s["start"] >= 0) & (s["end"] > s["start"]) & s["score"].between(0, 1) & (s["entity_type"] != "")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"])


def rebuilt(s: Column, **changes: Column) -> Column:
    """A span with some fields replaced."""
    names = ("start", "end", "entity_type", "text", "score", "recognizer", "metadata")
    return F.struct(*[changes.get(n, s[n]).alias(n) for n in names])


def shift(s: Column, delta: Column | int) -> Column:
    d = delta if isinstance(delta, Column) else F.lit(delta)
    return rebuilt(s, start=(s["start"] + d).cast("int"), end=(s["end"] + d).cast("int"))


#: White space as Python's strip() knows it.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def trimmed(s: Column) -> Column:
    """The span without blanks at its ends; of a blank one start equals end."""
    lead = F.length(F.regexp_extract(s["text"], f"^({BLANK}*)", 1))
    kept = F.regexp_replace(s["text"], f"^{BLANK}+|{BLANK}+$", "")
    return rebuilt(s, start=(s["start"] + lead).cast("int"), end=(s["start"] + lead + F.length(kept)).cast("int"), text=kept)


def to_dict(s: Column) -> Column:
    return F.to_json(s)


def to_dict_safe(s: Column) -> Column:
    """The record without its text, with its length."""
    return F.to_json(
        F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["end"] - s["start"]).alias("length"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["recognizer"].alias("recognizer"), s["metadata"].alias("metadata"))
    )
