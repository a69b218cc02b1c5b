"""Quality rules: an ordered decision list learned by sequential covering, applied as Spark conditionals.

Only DataFrame functions run on the rows. Learning keeps one small table of binned statistics (its row
count is bounded by ``sample_rows``) and asks Spark for counts; the driver sees counts per
(statistic, bin) and nothing else.

Defined results: a null or blank text has no words, so it fails the base test; rows with null ids are kept
or dropped by their text alone; repeated rows are judged alike; with no labelled rows the list is empty and
the base test alone decides; extra columns pass through ``apply_rules`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SEPARATORS, bounded_sample, id_residue, let, stored, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the rules may test, as expressions over the fields of the statistics struct `s`.
TESTED = {
    "n_words": lambda s: s["n_words"].cast("double"),
    "mean_word_chars": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbols_per_word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "dup_lines_per_line": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeat_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "distinct_share": lambda s: s["n_distinct_words"] / F.greatest(s["n_words"], F.lit(1)),
    "digits_per_char": lambda s: s["n_digits"] / F.greatest(s["word_chars"], F.lit(1)),
    "capitals_per_char": lambda s: s["n_capitals"] / F.greatest(s["word_chars"], F.lit(1)),
    "stops_per_word": lambda s: s["n_stops"] / F.greatest(s["n_words"], F.lit(1)),
    "words_per_line": lambda s: s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
}


@dataclass(frozen=True)
class Condition:
    """statistic <= threshold, or statistic > threshold."""

    statistic: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = TESTED[self.statistic](stats)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Conditions that together reject a document."""

    conditions: tuple[Condition, ...]

    def column(self, stats: Column) -> Column:
        return reduce(lambda a, b: a & b, (c.column(stats) for c in self.conditions))

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


def _dropped(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _covered(w: Column) -> Column:
    """Words that lie in a window of three words found at least twice.

    Windows are sorted by their 64-bit hash, so equal ones are neighbours: n log n for any text.
    """

    def windows(n: Column) -> Column:
        at = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        )
        return F.when(n >= 3, F.sort_array(at))

    def positions(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))

    return F.coalesce(let(windows(F.size(w)), lambda s: F.size(F.array_distinct(positions(s)))), F.lit(0)).cast("long")


def statistics(text: Column) -> Column:
    """A struct of whole-text statistics; all fields are long and none is null."""

    def fields(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
        bare = _dropped(t, SEPARATORS)

        def of_words(w: Column) -> Column:
            return let(
                lines,
                lambda ln: let(
                    bare,
                    lambda b: F.struct(
                        F.size(w).cast("long").alias("n_words"),
                        F.length(b).cast("long").alias("word_chars"),
                        (F.length(b) - F.length(_dropped(b, "#*$%&|<>"))).cast("long").alias("n_symbols"),
                        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                        _covered(w).alias("n_repeat_words"),
                        F.size(ln).cast("long").alias("n_lines"),
                        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
                        (F.length(b) - F.length(_dropped(b, "0123456789"))).cast("long").alias("n_digits"),
                        (F.length(b) - F.length(_dropped(b, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
                        (F.length(b) - F.length(_dropped(b, ".,;:!?"))).cast("long").alias("n_stops"),
                    ),
                ),
            )

        return let(words_of(t), of_words)

    return let(F.coalesce(text, F.lit("")), fields)


def base_failed(stats: Column) -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20000) -> DataFrame:
    """Statistics of at most `sample_rows` labelled documents, a third of them marked for pruning.

    The sample is the bound on what learning holds. Documents with residue 0 modulo 5 are left out, for
    measuring. Only the sampled ids are broadcast.
    """
    chosen = bounded_sample(
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_residue(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.max(label).alias("y")),
        "doc_id",
        sample_rows,
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    s = F.col("s")
    # stored first: a filter on the statistics would otherwise move below the join and compute them for every document
    known = stored(texts.select("doc_id", "y", statistics(F.col("text")).alias("s")))
    return known.where(~base_failed(s)).select(
        (F.col("y") == 0).alias("bad"),
        (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("prune")), F.lit(3)) == 0).alias("for_pruning"),
        s,
    )


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    cuts = [i / bins for i in range(1, bins)] + [0.98, 0.99, 0.995]
    found = rows.agg(*[F.percentile_approx(TESTED[k](F.col("s")), cuts, 2000).alias(k) for k in TESTED]).first()
    return {k: sorted(set(found[k] or [])) for k in TESTED}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """Per statistic and bin: (bad, good) rows. One job, one row per (statistic, bin) comes back."""
    names = [k for k in cuts if cuts[k]]
    if not names:
        return {}

    def bin_of(name: str) -> Column:
        return let(TESTED[name](F.col("s")), lambda v: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[name]]), lambda c: v > c)))

    bins = [bin_of(k) for k in names]
    out = {k: [[0, 0] for _ in range(len(cuts[k]) + 1)] for k in names}
    for r in (
        rows.select("bad", F.posexplode(F.array(*bins)).alias("k", "b"))
        .groupBy("k", "b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    ):
        out[names[r["k"]]][r["b"]] = [r["bad"], r["good"]]
    return out


def _best(counts: dict[str, list[list[int]]], cuts: dict[str, list[float]], least: int) -> tuple[Condition, float, tuple[int, int]] | None:
    """The condition of the largest gain in information on the covered bad rows."""
    import math

    best = None
    for name, per_bin in counts.items():
        bad, good = (sum(b[i] for b in per_bin) for i in (0, 1))
        if not bad:
            continue
        before, low = math.log2(bad / (bad + good)), [0, 0]
        for at, cut in enumerate(cuts[name]):
            low = [low[0] + per_bin[at][0], low[1] + per_bin[at][1]]
            for above, (p, n) in ((False, low), (True, (bad - low[0], good - low[1]))):
                if p < least or (p, n) == (bad, good):
                    continue
                gain = p * (math.log2(p / (p + n)) - before)
                if gain > 1e-9 and (best is None or gain > best[1]):
                    best = (Condition(name, above, cut), gain, (p, n))
    return best


def learn(
    rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 24, precision: float = 0.85, least: int = 8
) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, remove what it covers, repeat.

    A rule stays only if on the pruning rows at least `precision` of what it rejects is bad.
    """
    rows = stored(rows.repartition(2))
    cuts = _thresholds(rows, bins)
    rules: list[Rule] = []
    left = rows
    for _ in range(max_rules):
        grown: list[Condition] = []
        reach = left.where(~F.col("for_pruning"))
        while len(grown) < max_conditions:
            found = _best(_counts(reach, cuts), cuts, least)
            if not found:
                break
            grown.append(found[0])
            reach = reach.where(found[0].column(F.col("s")))
            if found[2][1] == 0:
                break
        if not grown:
            break
        held = left.where("for_pruning")
        prefixes = [Rule(tuple(grown[: i + 1])).column(F.col("s")) for i in range(len(grown))]
        got = held.agg(*[F.count_if(m & (F.col("bad") if b else ~F.col("bad"))).alias(f"{'p' if b else 'n'}{i}") for i, m in enumerate(prefixes) for b in (True, False)]).first()
        scored = [(got[f"p{i}"], got[f"n{i}"]) for i in range(len(grown))]
        worth = [((p - n) / (p + n) if p + n else -1.0, p, i) for i, (p, n) in enumerate(scored)]
        value, _, i = max(worth)
        p, n = scored[i]
        if p + n == 0 or p / (p + n) < precision:
            break
        rules.append(Rule(tuple(grown[: i + 1])))
        left = left.where(~rules[-1].column(F.col("s")))
    return rules


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """The ordered list as one conditional: base failures and the first rule that holds reject, else the text is kept."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(False))
    return out.otherwise(F.lit(True))


def score(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row."""
    s = F.col("s")
    return docs.select("doc_id", statistics(F.col("text")).alias("s")).select(
        "doc_id", *[s[c].alias(c) for c in BASE], base_failed(s).alias("base_failed"), verdict(s, rules).alias("kept")
    )


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that the list keeps, with their own columns."""
    return docs.where(let(statistics(F.col("text")), lambda s: verdict(s, rules)))
