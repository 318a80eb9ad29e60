"""The two models against plain loops, and whole queries over a small table against those loops."""

import math
import random
import re
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from merrow.llm import queries
from merrow.llm.labelled import fit_logistic, training_sample
from merrow.llm.quality import CompressionQuality, fit_quality, score_quality
from merrow.llm.toxicity import SubwordSoftmax, fit_toxicity, gradients, keep_clean, score_toxicity

from .test_models_and_pipeline import rude, texts

DIR, TOP = "/root/testdata/sf0.001", (1 << 64) - 1


def buckets(word, bits):
    """The n-grams of one word with a space at both ends, by the polynomial hash of their code points."""
    found, marked = set(), f" {word} "
    for n in (3, 4, 5):
        for i in range(len(marked) - n + 1):
            h = 0
            for c in marked[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) & TOP
            found.add((((h + n) * 0x9E3779B97F4A7C15) & TOP) >> (64 - bits))
    return found


def plain_toxicity(model, text):
    words = re.sub(r"[\W\d_]+", " ", text.lower()).split()
    windows = {}
    for i, word in enumerate(words):
        windows.setdefault((i + 1) // model.window, set()).update(buckets(word, model.bits))
    windows = [w for w in windows.values() if w]
    means = sorted((sum(float(model.table[b]) for b in w) / max(len(w), model.least) for w in windows), reverse=True)
    x = [means[0], sum(means[:3]) / 3, math.log(len(means))] if means else [0.0, 0.0, 0.0]
    z = sum(a * b for a, b in zip(x, model.curve[:-1], strict=True)) + model.curve[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def plain_quality(model, text):
    data, sizes = text.encode(), []
    for d in model.dictionaries:
        c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(data[i : i + model.block])) for i in range(0, len(data), model.block)))
    a, b = sizes
    ratio = min((a + b) / 2 / max(1, len(data)), 1.0)
    x = [10 * (b - a) / max(1, a + b), ratio, ratio * ratio]
    z = sum(p * q for p, q in zip(x, model.curve[:-1], strict=True)) + model.curve[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    vectors, heads = rng.normal(size=(9, 3)).astype(np.float64), rng.normal(size=(3, 2))
    bias, labels, weight = np.array([0.5, -0.5]), np.array([1, 0, 1]), np.array([0.7, 1.2, 0.7])
    bags = [np.array([0, 2, 5]), np.array([2, 8]), np.array([1, 2, 3, 4])]

    def loss():
        total = 0.0
        for bag, y, w in zip(bags, labels, weight, strict=True):
            mean = [sum(vectors[i][d] for i in bag) / max(len(bag), 4) for d in range(3)]
            logits = [sum(mean[d] * heads[d][c] for d in range(3)) + bias[c] for c in range(2)]
            total -= w * (logits[y] - math.log(sum(math.exp(z) for z in logits)))
        return total / len(bags)

    ids, by_vector, by_head = gradients(vectors, heads, bias, bags, labels, weight, 4)
    assert ids.tolist() == [0, 1, 2, 3, 4, 5, 8]
    for table, rows, found in ((vectors, ids, by_vector), (heads, range(3), by_head)):
        for k, i in enumerate(rows):
            for d in range(table.shape[1]):
                keep, step = table[i, d], 1e-5
                table[i, d] = keep + step
                up = loss()
                table[i, d] = keep - step
                down = loss()
                table[i, d] = keep
                assert abs((up - down) / (2 * step) - found[k, d]) < 1e-5


def test_curve_is_a_minimum():
    rng = np.random.default_rng(5)
    x, share = rng.normal(size=(300, 2)), 0.2
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(int)
    w = fit_logistic(x, y, share)
    ones = int(y.sum())
    g = [0.0] * 3
    for row, label in zip(x.tolist(), y.tolist(), strict=True):
        row = [*row, 1.0]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, w, strict=True))))
        weight = (share / ones if label else (1 - share) / (300 - ones)) * 300
        g = [a + weight * (p - label) * b for a, b in zip(g, row, strict=True)]
    ridge = (1e-3, 1e-3, 1e-6)
    assert max(abs(a + r * b) for a, b, r in zip(g, w, ridge, strict=True)) < 1e-3


def test_scores_are_those_of_plain_loops():
    extra = ["", "123 !!!", "É " * 50, "x" * 300_000, "ab " * 40_000, "<b>idiot</b> you_idiot ID1OT"]
    model = SubwordSoftmax(epochs=3).fit(texts(1, 120, rude), 0.5)
    mine = [t for t, _ in texts(6, 40, rude)] + extra
    assert np.allclose(model.score(mine), [plain_toxicity(model, t) for t in mine], atol=1e-5)
    junk = CompressionQuality(block=64).fit([(t, 1 - y) for t, y in texts(3, 200, rude)], 0.5)
    assert np.allclose(junk.score(mine), [plain_quality(junk, t) for t in mine], atol=1e-9)


def check_query(spark, name, fit, plain, threshold):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = fit(docs, labels)
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, DIR).collect()}
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(rows) == set(text)
    for i, t in text.items():
        want = plain(model, t) if model.curve is not None else model.share
        assert abs(rows[i].score - want) < 1e-5 and rows[i].predicted == int(rows[i].score >= threshold)
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_whole_queries_against_plain_loops(spark):
    check_query(spark, "op5_toxicity", fit_toxicity, plain_toxicity, 0.7)
    check_query(spark, "op9_quality", fit_quality, plain_quality, 0.5)


def test_sample_of_long_texts_and_repeated_labels(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choices("abc ", k=500 if i % 2 else 50)), 1) for i in range(90)] + [(None, "x", 1)], "doc_id long, text string, label int")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic", "1 AS text")
    few, _ = training_sample(docs, labels, "toxic", 3, 100)
    assert len(few) == 6 and all(len(t) == 50 for t, _ in few)
    long, share = training_sample(docs.where("doc_id % 2 = 1"), labels, "toxic", 5, 100)
    assert len(long) == 10 and all(len(t) == 100 for t, _ in long) and 0 < share < 1
    twice, _ = training_sample(docs, labels.unionByName(labels.withColumn("toxic", F.lit(1))), "toxic", 90, 100)
    assert {y for _, y in twice} == {1}
    assert training_sample(docs.limit(0), labels.limit(0), "toxic", 5, 100) == ([], 0.0)


def test_clashing_names_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "ab " * 700_000, True, 0.5), (2, None, None, None), (2, "x", True, 0.1)], "doc_id long, text string, held_out boolean, score double")
    toxic, good = SubwordSoftmax(epochs=2).fit(texts(1, 60, rude), 0.5), CompressionQuality(block=64).fit(texts(3, 60, rude), 0.5)
    for out in (score_toxicity(docs, toxic), score_quality(docs, good)):
        assert out.columns == ["doc_id", "held_out", "score", "predicted"] and sorted(r.doc_id for r in out.collect()) == [1, 2, 2]
    assert keep_clean(docs, toxic).columns == docs.columns
