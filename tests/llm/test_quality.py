import math
import re
from collections import Counter

import numpy as np
import xxhash

from folioforge.llm import common, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_counts_against_brute_force_and_model_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = quality.train(docs, labels)
    assert model.held_out_accuracy > 0.95
    got = quality.quality_rules(docs, model).toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d, r in got.iterrows():
        assert tuple(r.iloc[:6]) == brute(texts[d]), d
        assert not (r.base_failed and r.kept)
    q = {r.doc_id: r.quality for r in labels.collect()}
    seen = got[got.index.isin(list(q)) & ~got.base_failed]
    good = np.array([q[d] for d in seen.index]) == 1
    assert (seen.kept[good]).mean() > 0.99
    assert (~seen.kept[~good]).mean() > 0.9


def plain_probability(text, model):
    """The calibrated probability, counted gram by gram in plain integers."""
    words = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = words + [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(words, words[1:])]
    counts = Counter(g * 0xD6E8FEB86659FD93 % 2**64 >> 53 for g in grams)
    for a, b, c in zip(text, text[1:], text[2:]):
        h = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
        counts[2048 + ((h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 21)] += 1
    x = {k: math.log1p(n) for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    z = model.slope * sum(v * float(model.weights[k]) for k, v in x.items()) / norm + model.offset
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_verdicts_against_a_plain_version_and_on_rows_never_trained_on(spark, sf):
    """Half of the labels train; of the other half recall of bad and good rows is read, base rules apart."""
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    half = labels.filter("pmod(xxhash64(doc_id, 7), 2) = 0")
    model = quality.train(docs, half)
    unseen = docs.join(labels.join(half, "doc_id", "left_anti").select("doc_id", "quality"), "doc_id")
    got = quality.quality_rules(unseen, model).join(unseen.select("doc_id", "text", "quality"), "doc_id").collect()
    judged = [r for r in got if not r.base_failed]
    for r in judged[:300]:
        p = plain_probability(r.text, model)
        assert abs(p - r.probability) < 1e-3 and r.kept == (r.probability >= 0.3)
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    print(f"unseen rows: {len(good)} good, {sum(good)} kept; {len(bad)} bad, {sum(bad)} kept; base rules: {sum(r.base_failed for r in got)} of {len(got)}")
    assert len(good) > 1000 and np.mean(good) > 0.995
    assert len(bad) > 50 and np.mean(bad) < 0.1


def test_repeated_windows():
    w = [b"w%d" % i for i in range(10)]
    for words in (w, w * 2, w[:8] * 3, [b"a"] * 20, w + [b"x"] + w[:8], [b"a"] * 8, []):
        n = brute(" ".join(x.decode() for x in words))[4]
        assert quality.repeated_words(words, quality._hashes(words)) == n


def test_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\x0b"), (4, "a b   é" * 30), (None, "x " * 100), (5, long), (5, long), (6, "one\n\n one\none\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as kept", "3 as n_words", "array(1, null) as extra")
    got = sorted((r.doc_id or 0, *r[1:7]) for r in quality.quality_rules(df, None).collect())
    assert got == sorted(((d or 0), *brute(t)) for d, t in rows)
    kept = quality.keep_good(df, None)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 5]
    assert quality.quality_rules(df.limit(0), None).count() == 0
    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.train(df, labels) is None
    assert quality.train(df, labels.limit(0)) is None
