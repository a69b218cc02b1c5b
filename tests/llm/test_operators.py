"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import bpe, context_tree, language_id, learned_partitions, mixing, quality_model, quality_rules, records, sharding, simhash
from quillon.llm.common import stored

PATTERN, TIKTOKEN, WORDS_JSON = public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(1)
VOCABULARY = ["".join(RNG.choice(list("abcdeorst"), RNG.integers(2, 8))) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def rows():
    base = [(i, prose(60 + 7 * (i % 9), i), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    near = [(100 + i, base[i][1].replace(" ", "\n", 1), "en", "s0") for i in range(5)] + [(110, base[0][1], "en", None), (111, base[0][1] + " extra", "de", "s1")]
    odd = [(200, None, None, None), (201, "", "en", "s1"), (202, " \t\n\x0b ", "en", "s2"), (203, "one", "en", "s2"), (204, "a b c", "en", "s3"), (205, "w " * 20000, "en", "s0"), (206, "x" * 30000, "fr", "s0"), (207, "é日本 😀 ﬁ", "xx", "s4"), (None, prose(60, 5), "en", "s1"), (1, base[1][1], "fr", "s1")]
    # 1 stands twice: a repeated row
    return base + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    return stored(d.withColumn("n_words", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("fp", F.lit("clash")).withColumn("row", F.lit("clash")).repartition(3))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(200, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


def test_quality_statistics(docs):
    got = quality_rules.score(docs, []).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) > 70
    for r in got:
        t, w = r["text"] or "", words(r["text"])
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_quality_rules_learn_a_planted_rule(spark, docs, none, labels):
    data = [(i, prose(80, i) + (" | # |" * 12 if i % 3 == 0 else "")) for i in range(400)]
    texts, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    rules = quality_rules.learn(quality_rules.labelled_statistics(texts, marks))
    assert rules
    kept = {r["doc_id"] for r in quality_rules.apply_rules(texts, rules).collect()}
    assert kept == {i for i in range(400) if i % 3}
    assert quality_rules.learn(quality_rules.labelled_statistics(none, labels)) == []
    assert quality_rules.apply_rules(docs, rules).columns == docs.columns


def brute_rules(rows, cuts, max_rules=8, max_conditions=3, precision=0.85, least=8):
    """Sequential covering by trying every condition on every row: (statistic, above, cut) lists."""
    holds = lambda c, r: (r["v"][c[0]] > c[2]) == c[1]
    rules, left = [], rows
    while len(rules) < max_rules:
        grown, reach = [], [r for r in left if not r["prune"]]
        while len(grown) < max_conditions:
            bad, best = sum(r["bad"] for r in reach), None
            for name in cuts:
                for cut in cuts[name]:
                    for above in (False, True):
                        covered = [r["bad"] for r in reach if holds((name, above, cut), r)]
                        p, n = sum(covered), len(covered) - sum(covered)
                        if p >= least and (p, n) != (bad, len(reach) - bad):
                            gain = p * (math.log2(p / (p + n)) - math.log2(bad / len(reach)))
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, (name, above, cut), n)
            if not best:
                break
            grown.append(best[1])
            reach = [r for r in reach if holds(best[1], r)]
            if best[2] == 0:
                break
        worth = []
        for i in range(len(grown)):
            hit = [r["bad"] for r in left if r["prune"] and all(holds(c, r) for c in grown[: i + 1])]
            p, n = sum(hit), len(hit) - sum(hit)
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, i, n))
        if not worth or worth and (max(worth)[1] + max(worth)[3] == 0 or max(worth)[1] / (max(worth)[1] + max(worth)[3]) < precision):
            break
        rules.append(grown[: max(worth)[2] + 1])
        left = [r for r in left if not all(holds(c, r) for c in rules[-1])]
    return rules


def test_quality_rules_equal_a_brute_force_learner(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(500):
        w = prose(80 + i % 50, i).split()
        if i % 4 == 0:
            w[::9] = ["#|#"] * len(w[::9])
        elif i % 7 == 0:
            w = [x.upper() if rng.random() < 0.6 else x for x in w]
        data.append((i, " ".join(w), int(not (i % 4 == 0 or i % 7 == 0 or rng.random() < 0.03))))
    texts, marks = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, quality int")
    known = stored(quality_rules.labelled_statistics(texts, marks))
    cuts = quality_rules._thresholds(known, 24)
    plain = [
        {"bad": r["bad"], "prune": r["for_pruning"], "v": r["v"].asDict()}
        for r in known.select("bad", "for_pruning", F.struct(*[f(F.col("s")).alias(k) for k, f in quality_rules.TESTED.items()]).alias("v")).collect()
    ]
    got = [[(c.statistic, c.above, c.threshold) for c in rule.conditions] for rule in quality_rules.learn(known)]
    want = brute_rules(plain, cuts)
    assert len(got) >= 2 and got == want
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.score(texts, quality_rules.learn(known)).collect()}
    rejected = lambda v: any(all((v[n] > c) == above for n, above, c in rule) for rule in want)
    stats = texts.select("doc_id", quality_rules.statistics(F.col("text")).alias("s")).select("doc_id", quality_rules.base_failed(F.col("s")).alias("b"), F.struct(*[f(F.col("s")).alias(k) for k, f in quality_rules.TESTED.items()]).alias("v"))
    assert all(verdicts[r["doc_id"]] == (not r["b"] and not rejected(r["v"].asDict())) for r in stats.collect())


def test_mixing(docs, none):
    got = mixing.plan_mix(docs).collect()
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(docs.repartition(5)).collect()))
    sizes = Counter()
    for _, t, _, s in rows():
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in full} if full else share
        rest -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    by_id = {r[0]: r for r in rows() if r[0] != 1}
    for r in got:
        if r["doc_id"] in by_id:
            _, t, _, s = by_id[r["doc_id"]]
            assert r["size"] == len(words(t)) and r["source_size"] == sizes[s] and math.isclose(r["target"], target[s]) and r["taken"] <= 3 * r["size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.plan_mix(none).count() == 0


def test_mix_meets_targets_without_ids(spark):
    data = [(None, prose(50 + i % 7, i), f"s{i % 3}") for i in range(3000)]
    got = mixing.plan_mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["target"]] += r["taken"]
        target[r["target"]] = r["target"]
    assert len(target) == 3 and all(abs(taken[t] - t) < 0.12 * t for t in target)


def fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(docs, none):
    got = simhash.classes(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("f"), "component_id").collect()
    data = rows()
    prints = [fingerprint(t) for _, t, *_ in data]
    group = list(range(len(data)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {g: min((d[0] for d, x in zip(data, group) if x == g and d[0] is not None), default=None) for g in set(group)}
    want = Counter((d[0], f"{p:016x}", least[g]) for d, p, g in zip(data, prints, group))
    assert Counter((r["doc_id"], r["f"], r["component_id"]) for r in got) == want
    assert simhash.classes(none).count() == 0


@pytest.mark.parametrize("width,radius,n", [(1, 4, 300), (4, 54, 200), (1, 0, 130), (4, 10, 65), (2, 31, 70)])
def test_bit_sliced_comparison(width, radius, n):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << 63, (n, width), dtype=np.uint64)
    for i in range(1, n, 2):
        prints[i] = prints[i - 1]
        for b in rng.choice(64 * width, rng.integers(0, radius + 4), replace=False):
            prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    q, p = simhash.within(prints, prints, radius)
    assert set(zip(q.tolist(), p.tolist())) == set(zip(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= radius)))


def test_large_buckets_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    base = np.uint64(0x123456789ABCDEF0)
    prints = [int(base) ^ (1 << (i % 60)) ^ (1 << (i * 7 % 60)) for i in range(300)]
    nodes = spark.createDataFrame([(p,) for p in sorted(set(prints))], "fp long")
    labels = simhash.components(simhash.links(nodes.select("fp", F.col("fp").alias("node")), 4))
    assert labels.select("label").distinct().count() == 1 and labels.count() == len(set(prints))


def test_near_duplicates_at_the_similarity(spark):
    data, wanted = [], []
    for i in range(60):
        w = prose(150, 1000 + i).split()
        data += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(w[:75] + ["new"] + w[75:]))]
        wanted.append((3 * i, 3 * i + 1))
        other = w[:]
        for j in range(5, 150, 9):
            other[j] = "changed"
        data.append((3 * i + 2, " ".join(other)))
    docs = spark.createDataFrame(data + [(None, "a b c d e f")], "doc_id long, text string")
    label = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(docs).collect()}
    assert all(label[a] == label[b] for a, b in wanted) and all(label[3 * i + 2] == 3 * i + 2 for i in range(60))
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {3 * i for i in range(60)} | {3 * i + 2 for i in range(60)} | {None}


def test_rows_without_an_id_of_their_own_stay(spark):
    odd = [(None, prose(80, 7000 + i)) for i in range(6)] + [(5, prose(80, 7100 + i)) for i in range(4)]
    near = [(None, odd[0][1] + " extra"), (3, odd[1][1]), (5, odd[6][1]), (9, odd[7][1] + " extra")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(odd + near)], "doc_id long, text string, row_id int").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # one of the two without an id that are alike, the one with an id of two alike, and of equal ids every text once
    alike = [x for x in got if x in (odd[0], near[0])]
    assert len(alike) == 1 and Counter(x for x in got if x not in alike) == Counter([near[1], *odd[2:]])


def edited_families(families, size, length=400):
    """Copies of texts with 4 to 9 words edited each, many of them alike at just about 0.8."""
    data = []
    for f in range(families):
        w, rng = prose(length, 8000 + f).split(), np.random.default_rng(f)
        for i in range(size):
            copy = w[:]
            for at in rng.choice(length, rng.integers(4, 10), replace=False):
                copy[at] = f"edit{rng.integers(1 << 30)}"
            data.append((1000 * f + i, " ".join(copy)))
    return data


def brute_classes(texts, similarity=0.8, width=5):
    """The least index that each text reaches by pairs of the similarity."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if group[i] != group[j] and len(x & y) >= similarity * len(x | y):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("chunk", [2048, 40])
def test_near_duplicates_of_large_families(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "FAMILY_ROWS", chunk)
    monkeypatch.setattr(simhash, "PIVOTS", 5)
    data = edited_families(4, 100)
    want = {data[i][0]: data[g][0] for i, g in enumerate(brute_classes([t for _, t in data]))}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 4 and got == want


def test_context_tree(spark, docs, none):
    got = context_tree.score(docs, depth=3).collect()
    data = [(i, (t or "").encode().lower().split()) for i, t, *_ in rows()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter()
    for i, w in data:
        if not held(i):
            count.update([*w, None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, w in data:
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        want[(i, held(i), len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got) and context_tree.score(none).count() == 0


def brute_tree(texts, depth):
    """Counts of every node (context, bits before), and the weighted probability of a node from them, all as a plain recursion."""
    count = {}
    for t in texts:
        padded = b"\n" * depth + t
        for i in range(depth, len(padded)):
            bits = f"{padded[i]:08b}"
            for d in range(depth + 1):
                for b in range(8):
                    count.setdefault((padded[i - d : i], bits[:b]), [0, 0])[int(bits[b])] += 1
    children = {}
    for context, bits in count:
        if context:
            children.setdefault((context[1:], bits), []).append((context, bits))

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)

    def weighted(node, extra, path):
        z, o = count[node]
        if node in path:
            z, o = z + (extra == 0), o + (extra == 1)
        own = kt(z, o)
        if len(node[0]) == depth:
            return own
        below = sum(weighted(c, extra, path) for c in children[node])
        top = max(own, below)
        return top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)

    return count, weighted


def test_context_tree_probabilities():
    texts = [context_tree.normal(prose(12, i)) for i in range(6)] + [context_tree.normal(None)]
    keys, counts = context_tree.summed(context_tree.grams(texts, 3))

    def cells(keys, counts):
        order, parts = context_tree.by_cell(keys, 3)
        return {c: context_tree.Cell(keys[order][a:b], counts[order][a:b], 3) for c, a, b in parts}

    trees = cells(keys, counts)
    sums = [(b, *row) for t in trees.values() for b, s in enumerate(t.sums) for row in zip(*s)]
    merged = {}
    for b, node, *rest in sums:
        merged[b, int(node)] = np.add(merged.get((b, int(node)), 0), rest)
    at, rest = np.array(list(merged)), np.array(list(merged.values()))
    top = context_tree.Top.of(at[:, 0], at[:, 1].astype(np.uint64), rest[:, 0].astype(np.int64), rest[:, 1].astype(np.int64), rest[:, 2])
    for t in trees.values():
        t.predict(top)
    empty = context_tree.Cell(keys[:0], counts[:0], 3)
    empty.predict(top)
    key = lambda context, byte: np.uint64(int.from_bytes(context[::-1] + bytes([byte]), "big"))
    log10 = lambda k: trees.get(int(context_tree.cell_of(np.array([k]), 3)[0]), empty).log10(np.array([k]))[0]
    for context in (b"\n\n\n", texts[0][:3], b"zzz", b"\xc3\xa9q"):
        assert math.isclose(sum(10 ** log10(key(context, x)) for x in range(256)), 1.0, rel_tol=1e-6)
    # bits of contexts seen at full depth: the weighted probability with one more bit, over that without
    count, weighted = brute_tree(texts, 3)
    for context, byte in [(b"\n\n\n", texts[1][0]), (texts[0][2:5], texts[0][5]), (texts[3][7:10], texts[3][10])]:
        bits, want = f"{byte:08b}", 0.0
        for b in range(8):
            root = (b"", bits[:b])
            path = {(context[3 - d :], bits[:b]) for d in range(4)}
            want += weighted(root, int(bits[b]), path) - weighted(root, None, ())
        assert math.isclose(log10(key(context, byte)), want / math.log(10), rel_tol=1e-6)
    # a context whose farther bytes were never seen ends where the known path does; the nearest two bytes decide
    assert math.isclose(log10(key(b"\x00" + texts[0][3:5], texts[0][5])), log10(key(b"\x01" + texts[0][3:5], texts[0][5])))


def test_context_tree_slabs_do_not_matter(spark, docs, monkeypatch):
    known = lambda: sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in context_tree.score(docs.repartition(1)).collect())
    whole = known()
    real = context_tree._slab_batches

    def small(batches, depth):
        context_tree.SLAB = 1000
        yield from real(batches, depth)

    monkeypatch.setattr(context_tree, "_slab_batches", small)
    assert all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-4) for a, b in zip(whole, known()))


def test_packing():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 56, 1000, dtype=np.uint64))
    assert (context_tree.unpacked_keys(context_tree.packed_keys(keys)) == keys).all() and len(context_tree.unpacked_keys(context_tree.packed_keys(keys[:0]))) == 0
    assert context_tree.unpacked_text(context_tree.packed_text(b"a b")) == b"a b" and context_tree.unpacked_text(context_tree.packed_text(b"")) == b""
    values = rng.normal(size=100) * 20
    assert np.allclose(context_tree.unpacked(context_tree.packed(context_tree.rounded(values)), np.float32), values, rtol=2.0**-16)


def test_learned_partitions(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(300, 16))]).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, x[3].tolist()), (2001, None), (2002, []), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [None] * 16), (2006, [float("inf")] * 16), (2007, [1.0] * 3), (None, x[0].tolist())]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = learned_partitions.search(vectors, F.col("vec_id") % 20 == 0).collect()
    ids, y = np.array([*range(len(x)), 2000]), np.concatenate([x, x[3:4]]).astype(np.float64)
    hits, per = 0, {}
    for r in got:
        per.setdefault(r["query_id"], []).append(r)
    assert set(per) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in per.items():
        s = (y * y[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(r["score"] == s[ids == r["vec_id"]][0] for r in found)
        hits += len(set(best) & {r["vec_id"] for r in found})
    assert hits / (20 * len(per)) >= 0.9
    few = learned_partitions.search(vectors.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4 and learned_partitions.search(vectors.limit(0), F.lit(True)).count() == 0


def test_learned_partitions_probe_few_parts_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(64, 24)), 50, axis=0) + 0.15 * rng.normal(size=(3200, 24))
    vectors = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, part string")
    router = learned_partitions.fit(vectors, parts=16)
    got = learned_partitions.search(vectors, F.col("vec_id") % 20 == 0, router=router).collect()
    s = x[::20] @ x.T
    s[np.arange(160), np.arange(0, 3200, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(found[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)])
    probes = (router.ranked(x[::20])[1] < router.share).sum(axis=1).mean()
    assert recall >= 0.9 and probes < 8, (recall, probes)


def test_many_parts_asked_make_few_rows(spark, monkeypatch):
    """Queries that ask all of 40 parts get k rows from each of 8 cells at most, and exactly the nearest, also from cells in chunks and blocks."""
    x = np.random.default_rng(3).normal(size=(2000, 16)).round(1)
    x[1500:1560] = x[7]  # equal vectors: ties by id
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    router = learned_partitions.fit(vectors, parts=40)
    router.share = 2.0
    made, plain = [], learned_partitions.found
    monkeypatch.setattr(learned_partitions, "found", lambda *a: made.append(plain(*a)) or made[-1])
    wanted = {}
    for i in range(0, 2000, 20):
        s = (x[i] * x).sum(axis=1)
        wanted[i] = [j for j in np.lexsort((np.arange(2000), -s)) if j != i][:20]
    for chunk, block in ((1 << 20, 8192), (100, 30)):
        monkeypatch.setattr(learned_partitions, "CHUNK", chunk)
        monkeypatch.setattr(learned_partitions, "BLOCK", block)
        got = {}
        for r in sorted(learned_partitions.search(vectors, F.col("vec_id") % 20 == 0, router=router).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert got == wanted
    assert made[0].count() <= 8 * 20 * 100


def test_repeated_query_ids_are_ranked_on_their_own(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist()), (40, x[41].tolist())] + [(1000 + i, x[7].tolist()) for i in range(90)]
    got = learned_partitions.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id").isin(20, 40)).collect()
    per = Counter(r["query_id"] for r in got)
    assert per == {20: 20, 40: 40}  # the row of 20 twice is one query, the two vectors of 40 are two
    assert sorted(r["rank"] for r in got if r["query_id"] == 20) == list(range(1, 21))
    assert all(r["query_id"] != r["vec_id"] for r in got)


def test_equal_vectors_that_cannot_be_nearest_are_left_out():
    ids = np.array([5, 5, 5, 9, 8, 7, 6, 1, 2, 3])
    x = np.array([[1.0, 2.0]] * 7 + [[0.0, 1.0]] * 3)
    kept = learned_partitions._best_of_equals(ids, x, 2)
    assert sorted(ids[kept].tolist()) == [1, 2, 3, 5, 5, 6, 7]


def test_balanced_parts():
    x = np.random.default_rng(2).normal(size=(600, 8))
    part = learned_partitions.balanced_parts(x, learned_partitions.nearest(x, x, 6), 5)
    assert np.bincount(part).max() <= math.ceil(600 / 5 * 1.05) and len(set(part.tolist())) == 5


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b"], 3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, real = net.padded([b"abc", b"x", b"hello"])
    target, weight = np.array([[1, 0], [0.3, 0.7], [0, 1.0]]), np.array([1.0, 2.0, 0.5])
    _, grads = net.gradients(codes, real, target, weight)
    for name in ("hf", "hb", "out", "cf", "xb"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape) if name != "xb" else (ord("l"), 2)
        eps, old = 1e-3, net.p[name][at]
        net.p[name][at] = old + eps
        up = net.gradients(codes, real, target, weight)[0]
        net.p[name][at] = old - eps
        down = net.gradients(codes, real, target, weight)[0]
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 5e-3 * max(1, abs(grads[name][at]))


def test_language_positions_equal_a_plain_recurrence():
    net = language_id.Network.fresh(["a", "b", "c"], 4, np.random.default_rng(2))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(word, side):
        x, u, c, h, out = net.p[f"x{side}"], net.p[f"h{side}"], net.p[f"c{side}"], [0.0] * 4, []
        for byte in word if side == "f" else reversed(word):
            g = [sum(h[k] * float(u[k, j]) for k in range(4)) for j in range(12)]
            a = [float(x[byte, j]) + float(c[j]) for j in range(12)]
            z, r = [sigmoid(a[j] + g[j]) for j in range(4)], [sigmoid(a[4 + j] + g[4 + j]) for j in range(4)]
            m = [math.tanh(a[8 + j] + r[j] * g[8 + j]) for j in range(4)]
            h = [(1 - z[j]) * h[j] + z[j] * m[j] for j in range(4)]
            out.append(h)
        return out if side == "f" else out[::-1]

    def of_word(word):
        total = np.zeros(3)
        for f, b in zip(states(word, "f"), states(word, "b")):
            s = np.array(f + b) @ net.p["out"] + net.p["bias"]
            total += s - np.log(np.exp(s - s.max()).sum()) - s.max()
        return total

    words_ = [b"abc", b"x", "é日本".encode(), b"longer-word"]
    assert np.allclose(net.of_words(words_), [of_word(w) for w in words_], atol=1e-4)
    text = "Abc x abc"
    total = of_word(b"abc") * 2 + of_word(b"x")
    z = (total - total.max()) / math.sqrt(7)
    labels_, scores = language_id.Labeller(net).label([text])
    assert labels_ == [net.labels[total.argmax()]] and math.isclose(scores[0], (np.exp(z) / np.exp(z).sum()).max(), rel_tol=1e-4)


def test_languages(spark, docs, none):
    en, fr = ["the", "and", "with", "thing", "hand"], ["les", "des", "où", "çà", "élan"]
    data = [(i, " ".join(np.random.default_rng(i).choice(en if i % 2 else fr, 12)), "en" if i % 2 else "fr") for i in range(120)]
    known = spark.createDataFrame(data + [(500, None, "en"), (501, "123 !?", "en"), (502, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predict(known, language_id.fit(known)).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in data)
    assert {got[i]["lang_pred"] for i in (500, 501, 502)} == {"und"}
    net = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(docs, net).collect()} == {"und"} and language_id.predict(none, net).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(TIKTOKEN), PATTERN)


def test_bpe_equals_tiktoken(codec):
    tiktoken = pytest.importorskip("tiktoken")
    model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = np.random.default_rng(4)
    alphabet = list("abcXYZ019 .,'\n\t\r\x1c\x1d\x85  é日本😀ß�ﬁ")
    texts = [t or "" for _, t, *_ in rows() if t != "x" * 30000] + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(400)] + ["it's we'll  x", "x" * 500, "<|endoftext|>"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == model.encode_ordinary(t), repr(t[:80])
        assert codec.decode(ids) == t.encode()


def test_perfect_hash_is_minimal(codec):
    keys = list(codec.ranks)
    numbers = codec.hash.number(codec._hashes(keys))
    assert sorted(numbers.tolist()) == list(range(len(keys)))


def test_bpe_memo_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    codec.memo = {}
    for i in range(20):
        t = prose(60, 3000 + i)
        assert codec.decode(codec.encode(t)) == t.encode() and len(codec.memo) <= 200


def test_bpe_round_trip(docs, none):
    path = TIKTOKEN
    got = bpe.round_trip(docs, path, PATTERN).collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want and bpe.round_trip(none, path, PATTERN).count() == 0
    decoded = bpe.decode_table(bpe.encode_table(docs, path, PATTERN), path, PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["data"])) for r in decoded) == Counter((i, (t or "").encode()) for i, t, *_ in rows())


def test_quality_model(spark, docs, none, labels):
    good, bad = VOCABULARY[:60], VOCABULARY[40:120]
    data = [(i, " ".join(np.random.default_rng(i).choice(good if i % 3 else bad, 60)), int(i % 3 > 0)) for i in range(300)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    model = quality_model.fit(texts, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality_model.score(texts, model).collect()}
    held = [(got[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9
    odd = quality_model.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd) and quality_model.score(none, model).count() == 0
    assert quality_model.keep_good(docs, model).columns == docs.columns
    assert {r["score"] for r in quality_model.score(docs, quality_model.fit(none, labels)).collect()} == {0.5}


def test_folded_model_equals_the_softmax_of_its_embedding():
    texts, ys = [prose(30, i) for i in range(40)], [i % 2 for i in range(40)]
    examples = []
    for t, y in zip(texts, ys):
        total = Counter(f for w in quality_model.words(t) for f in quality_model.word_features(w))
        n = sum(total.values())
        examples.append((y, np.array(list(total)), np.array([c / n for c in total.values()], np.float32)))
    table, out = quality_model.embed(examples, epochs=3)
    raw = []
    for t in texts:
        vectors = [table[f] for w in quality_model.words(t) for f in quality_model.word_features(w)]
        z = np.mean(vectors, axis=0) @ out
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        raw.append(math.log(p[1] / p[0]))
    slope, offset = quality_model._calibrated(np.array(raw), np.array(ys))
    model = quality_model.train(examples, epochs=3)
    assert np.allclose([model.score(t) for t in texts], [1 / (1 + math.exp(-(slope * r + offset))) for r in raw], atol=2e-3)


def test_quality_model_of_text_ids(spark):
    texts = spark.createDataFrame([(f"d{i}", prose(40, i)) for i in range(30)], "doc_id string, text string")
    marks = spark.createDataFrame([(f"d{i}", i % 2) for i in range(30)], "doc_id string, quality int")
    assert quality_model.score(texts, quality_model.fit(texts, marks)).count() == 30


def test_records(spark, docs, none):
    from pyarrow import fs
    from tokenizers import Tokenizer

    path, folder = WORDS_JSON, records.new_folder(spark)
    manifest = records.write(docs, folder, path, parts=3)
    got = records.read(manifest, folder, with_ids=True).orderBy("start").collect()
    library, at = Tokenizer.from_file(path), 0
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in order)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    store, base = fs.FileSystem.from_uri(folder)
    name = manifest.orderBy("part").first()["file"]
    index, width = records.read_index(store, f"{base}/{name}.idx")
    key, ids = records.read_at(store, f"{base}/{name}.rec", *index[1][:2], width)
    assert key == got[1]["doc_id"] and ids.tolist() == got[1]["ids"]
    with pytest.raises(ValueError, match="checksum"):
        broken = bytearray(records.frame(b"payload"))
        broken[14] ^= 1
        records.unframe(bytes(broken), 0)
    empty = records.new_folder(spark)
    assert records.read(records.write(none, empty, path), empty).count() == 0


def test_records_of_special_tokens(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "B", " ", "\n", "é", ".", "end", "\u00a0", "7"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(1500)]
    plain, as_text = Tokenizer.from_file(WORDS_JSON), Tokenizer.from_file(WORDS_JSON)
    as_text.encode_special_tokens = True
    for library, flag in ((plain, False), (as_text, True)):
        encoder = records.WordTokenizer(library.to_str(), flag)
        for lo in range(0, len(texts), 100):
            for t, got in zip(texts[lo : lo + 100], encoder.encode(texts[lo : lo + 100], b"")):
                assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_of_one_frequent_key(spark, monkeypatch):
    from pyspark.sql.types import LongType

    data = [(None, prose(30, i)) for i in range(300)] + [(-(1 << 63), "least"), (0, "zero"), ((1 << 63) - 1, "most"), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    folder = records.new_folder(spark)
    manifest = records.write(docs, folder, WORDS_JSON, parts=4)
    assert manifest.count() == 4 and manifest.agg(F.max("n_records")).first()[0] < 150
    got = [r["doc_id"] for r in records.read(manifest, folder).orderBy("start").collect()]
    assert got == [None] * 301 + [-(1 << 63), 0, (1 << 63) - 1] and isinstance(docs.schema["doc_id"].dataType, LongType)
    with pytest.raises(TypeError, match="integer"):
        records.write(docs.withColumn("doc_id", F.col("doc_id").cast("string")), folder, WORDS_JSON)


def test_shards(spark, docs, none):
    data = [(i, prose(5 + i % 40, i)) for i in range(1500)] + [(5000 + i, "copy of one text " * 8) for i in range(700)] + [(None, None)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = sharding.shard(table, 8).collect()
    size, slots, home = Counter(), {}, {}
    texts = dict(data)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        home.setdefault(t, set()).add(r["shard"])
    assert len(got) == len(data) and set(size) == set(range(8)) and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(h) > 1 for t, h in home.items()) <= 8
    assert sharding.shard(docs, 4).count() == docs.count() and sharding.shard(none, 4).count() == 0


def test_cuts_of_the_tree_equal_weighted_quantiles(spark):
    data = [(i, prose(3 + i * i % 90, i) + "\n" * (i % 5)) for i in range(900)] + [(2000 + i, "copy " * 40) for i in range(300)]
    rows_ = stored(sharding._tied(stored(sharding.metadata(spark.createDataFrame(data, "doc_id long, text string"))), 6, 0.02))
    root = sharding.grow(rows_, 6)
    plain = [r.asDict() for r in rows_.collect()]
    scale = {d: max(1, max(r[d] for r in plain) - min(r[d] for r in plain) + 1) for d in sharding.DIMENSIONS}

    def check(node, part):
        if node.left is None:
            return
        width = {d: max(r[d] for r in part) - min(r[d] for r in part) + 1 for d in sharding.DIMENSIONS}
        assert node.dimension == max(sharding.DIMENSIONS, key=lambda d: (width[d] / scale[d], -sharding.DIMENSIONS.index(d)))
        total = sum(r["size"] for r in part)
        want, enough = total * (node.shards // 2) // node.shards, int(sharding.TOLERANCE * total / node.shards)
        order, passed, exact = sorted(part, key=lambda r: (r[node.dimension], r["tie"])), 0, 0
        for r in order:
            passed += r["size"]
            exact = passed if passed <= want else exact
        left = [r for r in part if (r[node.dimension], r["tie"]) < node.cut]
        assert exact - enough <= sum(r["size"] for r in left) <= want
        check(node.left, left)
        check(node.right, [r for r in part if (r[node.dimension], r["tie"]) >= node.cut])

    check(root, plain)


def test_pipeline_stages_keep_columns(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()


def test_pipeline_equals_brute_force_by_stage(spark, docs, labels, tmp_path):
    import corpus_pipeline
    import tiktoken

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    base = spark.createDataFrame([(3000 + i, prose(90, 60 + i) + f" tail{i}", "en", f"s{i % 3}") for i in range(40)] + [(4000 + i, prose(90, 60 + i) + " other", "en", None) for i in range(0, 40, 2)], "doc_id long, text string, lang string, source string")
    odd = docs.select("doc_id", "text", "lang", "source")
    now = stored(base.unionByName(odd).withColumn("row_id", F.lit(7)).repartition(3))
    rows_of = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stored(stages[name](spark, df, str(tmp_path)))

    rules = quality_rules.learn(quality_rules.labelled_statistics(now, labels))
    verdicts = Counter((r["doc_id"], r["kept"]) for r in quality_rules.score(now, rules).collect())
    kept = run("quality rules", now)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: n for (i, ok), n in verdicts.items() if ok})
    assert all(len(words(t)) >= 50 for _, t, _ in rows_of(kept))

    model = quality_model.fit(kept, labels)
    good = run("quality classifier", kept)
    assert rows_of(good) == Counter({k: n for k, n in rows_of(kept).items() if model.score(k[1]) >= 0.3})

    one = run("near-duplicates", good)
    before = sorted(rows_of(good).elements(), key=str)
    group = brute_classes([t for _, t, _ in before])
    least = {}
    for row, g in zip(before, group):
        key = (row[0] is None, row[0] or 0)
        least[g] = min(least.get(g, key), key)
    after = rows_of(one)
    assert after.total() == len(least) and Counter((i is None, i or 0) for i, _, _ in after.elements()) == Counter(least.values()) and not after - rows_of(good)

    mixed = run("mixing", one)
    plan = Counter()
    for r in mixing.plan_mix(one).collect():
        plan[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +plan and mixed.columns == now.columns

    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(TIKTOKEN), special_tokens={})
    done = stages["byte-level BPE"](spark, mixed, str(tmp_path)).collect()
    want = Counter((i, len(encoding.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rows_of(mixed).elements())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in done) == want


def test_pipeline_of_an_empty_table(spark, none, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)))
        assert now.count() == 0
