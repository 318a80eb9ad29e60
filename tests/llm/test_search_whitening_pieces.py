"""Ranked search, whitening and SentencePiece coding against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from merrow.llm.pieces import Pieces, encode_pieces
from merrow.llm.ranked_search import Block, search
from merrow.llm.whitening import deviations, whiten

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- ranked search


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c > "\x7f" else " " for c in low).split(" ")


def plain_search(docs, items, k):
    held = [(i, Counter(t for t in plain_terms(text) if t)) for i, text in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for item, text in items:
        asked[item].update(t for t in plain_terms(text) if t)
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS term", "1 AS n", "2 AS block")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS w", "4 AS doc_id")
    return sorted((tuple(r) for r in search(left, right, **more).collect()), key=str)


def test_search_equals_plain_scores(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "γάμμα", "d9", "the", "of", "x", "Éa", "中文", "rare1", "rare2", "it's", "a-b", "tab\tend", "nul\x00nul"]
    weights = [5, 4, 3, 3, 30, 25, 9, 2, 2, 1, 1, 2, 2, 1, 1]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 200]))) for i in range(300)] + [(400 + i, "the of the same") for i in range(40)]
    docs += [(None, "rare1 nobody"), (500, None), (501, ""), (502, " .,; "), (7, "alpha again"), (503, "the " * 30_000)]
    items = [(0, text(40)), (1, "the same"), (2, None), (3, "unseen words"), (4, "rare1 rare1 rare2"), (4, "alpha"), (None, "beta the"), (5, "")]
    for more in ({}, {"block": 300, "chunk": 7, "k": 4}):
        assert found(spark, docs, items, **more) == plain_search(docs, items, more.get("k", 10))
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_search_splits_prunes_and_keeps_ties(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(Block, "LEAF", 16)
    for _ in range(30):
        lists, docs = np.divmod(rng.choice(12 * 500, 3000, replace=False), 500)
        impacts = rng.integers(0, 5 if rng.random() < 0.3 else 10**6, 3000)
        block = Block(lists, docs, impacts, 12, 500)
        asked, times = np.arange(0, 12, 2), rng.integers(1, 4, 6)
        plain = Counter()
        for a, t in zip(asked, times):
            for d, i in zip(docs[lists == a], impacts[lists == a]):
                plain[int(d)] += int(t * i)
        assert block.search(asked, times, 7) == [(s, d) for s, d in sorted(((s, d) for d, s in plain.items() if s), key=lambda x: (-x[0], x[1]))[:7]]
    # a term that few documents have with a high impact: the rest is bounded away
    lists, docs = np.repeat(np.arange(2), 50_000), np.tile(np.arange(50_000), 2)
    impacts = np.where(lists == 0, 1, 0) + np.where((lists == 1) & (docs % 5000 == 17), 1000, 0)
    block = Block(lists, docs, impacts, 2, 50_000)
    assert [d for _, d in block.search(np.arange(2), np.ones(2, np.int64), 5)] == [17, 5017, 10017, 15017, 20017]
    assert block.scored < 1000


# --- whitening


def rows_of(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "2 AS n", "'k' AS key", "3 AS size")


def check_whitening(spark, data, counts=True):
    good = [(i, v) for i, v in data if v and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 100_000
    fit = x if counts else np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    covariance = (fit - total / n).T @ (fit - total / n) / n
    e, axes = np.linalg.eigh(covariance)
    got = defaultdict(list)
    for r in whiten(rows_of(spark, data), weights="counts" if counts else "one").collect():
        got[r.vec_id, r.component].append(r)
    assert set(got) == {(i, c) for i, _ in good for c in range(1, 6)}
    for (i, c), rows in got.items():
        mine = [k for k, (j, _) in enumerate(good) if j == i]
        assert len(rows) == len(mine) and {r.n for r in rows} == {n}
        assert sorted(r.deviation for r in rows) == sorted(((n * x[k] - total) ** 2).sum() for k in mine)
        want = sorted(abs((x[k] - total / n) @ axes[:, -c]) / math.sqrt(e[-c]) for k in mine)
        assert np.allclose(sorted(abs(r.whitened) for r in rows), want, rtol=1e-9, atol=1e-9)
        assert math.isclose(rows[0].explained, e[-c] / e.sum(), rel_tol=1e-9) and rows[0].identity_error < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(c) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 0.2]]) for i in range(200)]
    data += [(300 + i, data[3][1]) for i in range(150)] + [(9, data[9][1]), (9, data[10][1])]
    data += [(600, None), (601, [1.0, None, 0.0, 0.0, 0.0]), (602, [math.nan] * 5), (603, [math.inf, 0.0, 0.0, 0.0, 0.0]), (604, []), (605, [1.0]), (606, [3e38] * 5)]
    check_whitening(spark, [r for r in data if r[0] != 606])
    check_whitening(spark, [r for r in data if r[0] != 606], counts=False)
    assert {r.vec_id for r in whiten(rows_of(spark, data)).collect()}.isdisjoint(range(600, 607))


def test_whitening_without_variance(spark):
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whiten(rows_of(spark, data)).collect() == []
    flat = whiten(rows_of(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(4)] + [(None, [9.0, 18.0, 1.0])])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 5 and flat[0].identity_error < 1e-9


def test_deviations_are_exact_or_null():
    x, total = np.array([[10**14, 3], [5, 5]]), np.array([7, 9])
    assert deviations(x, 10**5, total) == [None, (5 * 10**5 - 7) ** 2 + (5 * 10**5 - 9) ** 2]
    assert deviations(np.array([[1 << 21, 0]]), 1 << 10, np.array([1, 1])) == [((1 << 31) - 1) ** 2 + 1]


# --- SentencePiece


@lru_cache
def library():
    return SentencePieceProcessor(model_file=MODEL)


@lru_cache
def coder():
    return Pieces.of(MODEL)


def same_coding(text):
    ids = library().encode(text, add_eos=True)
    assert coder().ids(text) == ids
    assert coder().decode(ids) == library().decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abeinorstTHE '.,-²\n\t▁é中の가\x00🎉<>0x1()=", max_size=40))
def test_ids_as_the_library(text):
    same_coding(text)


def test_pieces_side_by_side_runs_of_spaces_and_long_texts():
    rng, pool = random.Random(7), list(coder().id)
    for _ in range(4000):
        same_coding("".join(rng.choices(pool, k=rng.randint(1, 6))))
    for n in range(70):
        same_coding(" " * n)
        same_coding("a" + " " * n + "b")
    for text in ("", "<s> </s> <unk> <0x0A>", "é", "\r\n", "​�", "in" * 40_000, " " * 50_000, "a b\n" * 100_000, "的" * 9_000, "".join(rng.choices("aeinrst", k=20_000))):
        same_coding(text)


def test_table_of_a_unit_is_that_of_many(monkeypatch):
    rng, pool = random.Random(8), list(coder().id)
    units = ["".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(3000)]
    for unit, ids in zip(units, coder().tokens_of(units)):
        assert min(ids) < 0 or ids == coder().tokens(unit)
    # each prefix's last token is the last one of the prefix's own encoding
    for unit in units[:300]:
        for p, token in enumerate(coder().last_tokens(unit)):
            if token >= 0:
                assert token == coder().tokens(unit[: p + 1])[-1]


def test_pairs_by_spines_as_by_merging():
    rng, c = random.Random(9), Pieces(MODEL)
    strict = sorted(c.strict)
    pairs = [(rng.choice(strict), rng.choice(strict)) for _ in range(20_000)] + [(c.id["t"], c.id["he"]), (c.id["in"], c.id["g"])]
    for a, b in pairs:
        assert c.meet(a, b) == (c.merged(c.text[a] + c.text[b])[0] == [c.text[a], c.text[b]])


def test_decoding_any_ids():
    rng = random.Random(10)
    for _ in range(2000):
        ids = [rng.choice([1, 2, rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randint(1, 8))]
        ids = [259 + 30, *ids]
        assert coder().decode(ids) == library().decode(ids), ids


def test_small_caches_and_tables_of_rows(spark, monkeypatch):
    texts = ["The cat, the hat.", None, "", "▁x y", "word " * 3000, "é́\x00🎉", "a" * 100, *[f"w{i} v{i % 7}" for i in range(400)]]
    small = Pieces(MODEL)
    monkeypatch.setattr(small, "CACHED", 50)
    monkeypatch.setattr(small, "CHUNK", 64)
    for text in texts:
        assert small.ids(text or "") == library().encode(text or "", add_eos=True)
        assert len(small.young) <= 50 + 64
    rows = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'z' AS n_tokens", "1 AS ids")
    want = []
    for i, t in enumerate(texts):
        ids = library().encode(t or "", add_eos=True)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library().decode(ids))]
        want.append((i if i % 5 else None, len(ids), *sha, ids, library().decode(ids)))
    got = [tuple(r) for r in encode_pieces(rows, MODEL, with_ids=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_pieces(rows.where("false"), MODEL).collect() == []
