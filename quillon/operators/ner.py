"""An optional model of named entities: any callable from texts to labelled spans, run on chunks in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from quillon.functions import word_lists as W
from quillon.operators import sequential as S

CHUNK, THRESHOLD = 800, 0.4
LABELS = {"person": "PERSON", "email": "EMAIL", "phone number": "PHONE", "location": "LOCATION", "address": "LOCATION", "organization": "ORGANIZATION", "company": "ORGANIZATION", "vat number": "VAT"}
Model = Callable[[str], list[tuple[int, int, str, float]]]


def chunks(text: str, limit: int = CHUNK) -> list[tuple[int, str]]:
    """(offset, part) of at most `limit` characters, cut after the last line end, else the last space."""
    out, at = [], 0
    while at < len(text):
        part = text[at : at + limit]
        if at + limit < len(text):
            cut = part.rfind("\n") + 1 or part.rfind(" ") + 1
            part = part[:cut] if cut else part
        out.append((at, part))
        at += len(part)
    return out


def plausible(s: S.Span, text: str, lexicon: frozenset[str]) -> bool:
    """No name of digits alone, no name wholly of lexicon words, no tax number without country letters or a label in the 40 characters before."""
    if s.entity_type in ("PERSON", "ORGANIZATION", "LOCATION"):
        if re.fullmatch(r"[\d\s.,/\-+()]+", s.text):
            return False
        words = [w for w in re.split(r"[\s'’\-./]+", S.fold(s.text)) if w]
        return not words or not all(w in lexicon or w in W.COMPANY_NOISE for w in words)
    if s.entity_type == "VAT":
        return bool(re.match(r"[A-Z]{2}\s?\d", s.text)) or bool(re.search(r"(?i)\b(?:tva|vat|ust|iva|nif|cif|nip|siren|siret|steuer\w*|fiscal\w*|tax)\b", text[max(0, s.start - 40) : s.start]))
    return True


def with_model(docs: DataFrame, load: Callable[[], Model], lexicon: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Rows with text and spans, a model's spans added; it is loaded once per task."""
    words = frozenset(map(S.fold, lexicon))
    held: list[Model] = []

    def rule(t: str, found: list[S.Span], _: list[str]) -> list[S.Span]:
        if not held:
            held.append(load())
        out = []
        for at, part in chunks(t):
            for a, b, label, score in held[0](part):
                s = S.Span(at + a, at + b, LABELS.get(label.lower(), label.upper()), part[a:b], float(score), "GLiNER", {})
                if score >= threshold and plausible(s, t, words):
                    out.append(s)
        return found + out

    return S.revised(docs, rule)
