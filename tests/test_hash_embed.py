"""Hashed vectors by plain counting; words are hashed once a batch."""

import hashlib
import math
import re

from merrow.operators import vectors


def plain(texts, dim):
    out = [0.0] * dim
    for text in texts:
        for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower().strip(" ")):
            d = hashlib.sha256(w.encode()).digest()
            if w:
                out[int.from_bytes(d[:4], "little") % dim] += 1.0 if d[4] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / n for x in out]


def test_vectors_of_odd_texts_and_shared_ids(spark):
    rows = [(1, "A b a  \t c\n"), (2, None), (3, ""), (4, "  "), (5, "\tx y"), (6, "é É ß"), (7, "one two"), (7, "two three"), (8, "a b a c")]
    got = vectors.hash_embed(spark.createDataFrame(rows, "k long, text string").repartition(3), 37, "k", "text").collect()
    assert sorted(r.k for r in got) == [k for k, _ in rows]
    for r in got:
        assert list(r.vec) == plain([t for k, t in rows if k == r.k], 37)


def test_no_row_for_each_word(spark):
    """Before, each word of each text was a row, with a digest of its own."""
    docs = spark.createDataFrame([(1, "a a b")], "k long, text string")
    plan = vectors.hash_embed(docs, 8, "k", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "explode(split" not in plan
    assert vectors.hash_embed(docs.where("false"), 8, "k", "text").count() == 0


def test_the_length_is_taken_once_a_vector(spark):
    """Before, each entry took it twice, so the work grew with the square of the dimension."""
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    made = rows.select(vectors.l2_normalize("v").alias("v"))
    assert [r.v for r in made.collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("sqrt(") == 1, plan
