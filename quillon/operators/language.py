"""The language of a text without a label: French, English, German or Japanese, by stop words, letters and script, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.regex import let

#: Frequent short words, and letters that the other two languages lack or seldom have.
STOP_WORDS = {
    "fr": ("de", "la", "le", "les", "des", "et", "en", "un", "une", "du", "que", "qui", "est", "dans", "pour", "pas", "par", "sur", "avec", "ce", "cette", "ceci", "au", "aux", "plus", "ne", "nous", "vous", "il", "elle", "sont", "mais", "ou", "bonjour"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by", "this", "are", "from", "at", "or", "an", "have", "not", "but", "you", "we", "they", "which", "will", "some", "hello"),
    "de": ("der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "des", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "werden", "aus", "hat", "dass", "sie", "nach", "wird", "bei", "dies", "wir", "guten", "tag"),
}
LETTERS = {"fr": "éèêàçùœ", "en": "", "de": "äöüß"}
#: Kana and Han.
JAPANESE = "[ぁ-ヿ㐀-鿿]"
UNKNOWN = "unknown"


def detect_language(text: Column) -> Column:
    """'fr', 'en', 'de', 'ja' or 'unknown'.

    Japanese if half of the letters are kana or Han; else the language of most evidence, two for a stop word and one for a letter of its own, the first named of
    equals. Null, blank and texts without evidence are unknown. The whole text counts.
    """
    t = F.coalesce(text, F.lit(""))

    def of(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
        stops = lambda k: F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS[k])))
        own = lambda k: F.length(low) - F.length(F.translate(low, LETTERS[k], "")) if LETTERS[k] else F.lit(0)
        score = {k: 2 * stops(k) + own(k) for k in STOP_WORDS}
        best = F.array_sort(F.array(*[F.struct((-s).alias("a"), F.lit(i).alias("b"), F.lit(k).alias("k")) for i, (k, s) in enumerate(score.items())]))[0]
        japanese = F.regexp_count(low, F.lit(JAPANESE))
        return F.when((japanese > 0) & (2 * japanese >= F.regexp_count(low, F.lit(r"\p{L}"))), F.lit("ja")).otherwise(let(best, lambda x: F.when(x["a"] == 0, F.lit(UNKNOWN)).otherwise(x["k"])))

    return let(F.lower(t), of)


def with_language(docs: DataFrame) -> DataFrame:
    """Documents whose null `lang` is filled with what their text shows; it stays null where that is unknown."""
    return docs.withColumn("lang", F.coalesce(F.col("lang"), F.nullif(detect_language(F.col("text")), F.lit(UNKNOWN))))
