"""Verdicts at two sizes."""

import random

import numpy as np

from pyspark.sql import functions as F

from polyview.llm.quality import grams, judge, keyed


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [[f"g{i}" for i in range(400)], [f"b{i}" for i in range(400)]]
    both = [f"c{i}" for i in range(200)]
    pairs = [(i, " ".join(rng.choice(words[i % 4 == 0] if rng.random() < 0.3 else both) for _ in range(90))) for i in range(n)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(n) if i % 5 < 2]
    return pairs, labels


def test_verdicts_agree_across_sizes(spark, make):
    kept = []
    for n in (240, 960):
        pairs, labels = corpus(n)
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rows = judge(make(pairs), frame).collect()
        kept.append([np.mean([r.kept for r in rows if (r.doc_id % 4 == 0) == bad and r.doc_id % 5 >= 2]) for bad in (False, True)])
    assert all(good > 0.9 and bad < 0.1 for good, bad in kept)


def test_grams_are_all_words_and_pairs_hashed_without_interpreted_functions(spark, make):
    texts = ["a b  c\ta b", "x", "", None, " \x0bé \u00a0 é\n"]
    frame = grams(keyed(make(list(enumerate(texts))), "doc_id", "text"), 1 << 10, "id")
    assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["id"], r["bucket"]) for r in frame.filter("bucket IS NOT NULL").collect())
    words = ["a b c a b".split(), ["x"], [], [], ["é", "\u00a0", "é"]]
    parts = [(i, [w]) for i, ws in enumerate(words) for w in ws] + [
        (i, list(p)) for i, ws in enumerate(words) for p in zip(ws, ws[1:])]
    want = []
    for i, p in parts:
        row = spark.range(1).select(F.pmod(F.xxhash64(*map(F.lit, p)), F.lit(1 << 10)))
        want.append((i, row.first()[0]))
    assert got == sorted(want)
    assert {r["id"] for r in frame.select("id").collect()} == set(range(5))
