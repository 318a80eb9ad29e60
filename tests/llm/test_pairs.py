import hashlib
import inspect
import random
from collections import Counter

import numpy as np

from merrow.llm import near_dedup, suffix_dedup
from merrow.llm.ann import CollisionIndex, nearest
from merrow.llm.common import Rolling, Tables
from merrow.llm.components import components
from merrow.llm.near_dedup import Signer, intersections, near_duplicates, shingle_set
from merrow.llm.suffix_dedup import multikey_order, remove_repeats

from .brute import components_of

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        words = rng.choices(WORDS, k=rng.choice([1, 2, 3, 6, 40, 120]))
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy))
    hub = rng.choices(WORDS, k=150)
    for _ in range(40):  # a crowd around one text, few of which are near enough to each other
        copy = list(hub)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    return [*enumerate(texts), (9001, None), (9002, ""), (9003, " \n"), (9004, "É e"), (9005, "É e")]


def against_brute(spark, rows):
    sets = {i: shingle_set(t or "", 4) for i, t in rows}
    near = lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = components_of(sets, near)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string"), shingle=4).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_near_duplicates_against_brute_force(spark):
    against_brute(spark, corpus(1, 60))


def test_near_duplicates_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    against_brute(spark, corpus(2, 40))


def test_near_duplicates_of_nothing_and_repeats(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], schema)).collect()
    assert [r.component_id for r in rows] == [1, 1, 1] and [r.kept for r in rows if r.doc_id == 1] == [True, True]


def test_signatures_estimate_similarity():
    signer, rng = Signer(1), random.Random(3)
    for share in (0.2, 0.5, 0.8):
        both = [f"b{i}" for i in range(300)]
        own = int(300 * (1 - share) / share / 2)
        x = signer.shingles(" ".join(both + [f"x{rng.random()}" for _ in range(own)]))
        y = signer.shingles(" ".join(both + [f"y{rng.random()}" for _ in range(own)]))
        assert abs((signer.signature(x) == signer.signature(y)).mean() - share) < 0.13


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(12)]
    got = intersections(sets, columns=16)
    assert all(i == j or got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 170)] + [(5, 150), (900, 901)], "a long, b long")
    got = {r.id: r.component for r in components(links, Tables(spark, "path")).collect()}
    assert got == {**{i: 5 for i in [5, *range(100, 171)]}, 900: 900, 901: 900}


def brute_repeats(rows, span):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["ab", "ba", "c ", "é", "dd\n", "a"]
    shared = ["".join(rng.choices(parts, k=rng.randint(20, 60))) for _ in range(6)]
    rows = [(d, "".join(rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 10)))) for d in range(120)]
    rows += [(7, rows[7][1]), (None, "a" * 90), (400, "a" * 50), (401, "xyz" * 40), (402, None), (403, "q" * 41)]
    for hot in (20_000, 3):
        got = remove_repeats(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int"), span=40, gram=12, hot=hot).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows, 40)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint8)) for _ in range(300)]
    grid = np.frombuffer(b"".join(s.ljust(24, b"\0") for s in strings), np.uint8).reshape(300, 24)
    order = multikey_order(grid.view(">u8").astype(np.uint64), np.array([len(s) for s in strings]))
    assert [(strings[i].ljust(24, b"\0"), len(strings[i])) for i in order] == sorted((s.ljust(24, b"\0"), len(s)) for s in strings)


def measured(x, queries, k=20):
    """(recall, share of the entries touched, share of the vectors verified) with the query's parameters."""
    given = {name: p.default for name, p in inspect.signature(nearest).parameters.items() if name in ("rotations", "share", "growth", "confidence")}
    index, hits = CollisionIndex(np.arange(len(x)), x, np.linalg.norm(x, axis=1).max() * (1 + 1e-12), **given), 0
    for q in queries:
        found, _ = index.search(x[q], q, k)
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(found.tolist()) & set(np.argsort(-scores, kind="stable")[:k].tolist()))
    n = len(queries)
    return hits / n / k, index.touched / n / index.m / len(x), index.verified / n / len(x)


def test_windows_leave_out_what_is_far_away():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64))
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    for n in (2_000, 8_000, 16_384):  # the largest block
        clustered = unit(centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 64)) * 0.1)
        recall, touched, verified = measured(clustered, range(0, n, n // 20))
        assert recall >= 0.9 and touched < 0.2 and verified < 0.05
        recall, _, verified = measured(unit(rng.normal(size=(n, 64))), range(0, n, n // 20))
        assert recall >= 0.9 and verified < 0.3


def test_repeated_rows_of_nearest(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [2.0, 0.0]), (1, [1.5, 0.0]), (2, [0.5, 0.1]), (2, [0.5, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 2.0), (0, 2, 1, 1.5), (0, 3, 2, 0.5)]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, (900, 1))
    x[200:330] = x[200]  # copies
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [1.0] * 5), (1005, [float("inf")] * 24), (None, [1.0] * 24)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = nearest(df, df.where("vec_id % 20 = 0"), k=20, block=256, query_block=16).collect()
    scores = x @ x.T
    found = {}
    for r in got:
        assert abs(r.score - scores[r.query_id, r.vec_id]) < 1e-9 and r.vec_id != r.query_id
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(found) == set(range(0, 900, 20))
    hits = 0
    for q, mine in found.items():
        assert [rank for rank, _ in sorted(mine)] == list(range(1, 21))
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-round(scores[q, i], 9), i))[:20]
        hits += len({v for _, v in mine} & set(order))
    assert hits / (20 * len(found)) >= 0.9
    assert [v for _, v in sorted(found[200])] == list(range(201, 221)) or x[200] @ x[200] < scores[200].max()
    few = nearest(df.where("vec_id < 4"), df.where("vec_id = 0"), k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def thue_morse(n, swap=False):
    bits = [bin(i).count("1") % 2 ^ swap for i in range(n)]
    return "".join("ab"[b] for b in bits)


def test_words_with_one_polynomial_hash_are_told_apart(spark):
    x, y = thue_morse(1024), thue_morse(1024, True)
    same = f"{x} {x} {y} {y} {x} {y} {y} {x} {x}"
    rows = [(1, f"{x} one two three"), (2, f"{y} one two three"), (3, same), (4, same.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (5, 3), 4: (5, 3)}


def test_equal_hashes_are_confirmed_on_full_sets(spark, monkeypatch):
    signed = near_dedup.signed
    monkeypatch.setattr(near_dedup, "signed", lambda rows, size: signed(rows, size).selectExpr("doc_id", "n", "0L AS h1", "0L AS h2", "signature"))
    against_brute(spark, corpus(4, 25))


def test_colliding_shingles_of_a_set_are_counted_apart(monkeypatch):
    monkeypatch.setattr(near_dedup, "mix64", lambda x: x & np.uint64(3))
    assert len(Signer(2).shingles("a b c d e f g h a b c")) == len(shingle_set("a b c d e f g h a b c", 2))


def test_very_long_text_and_windows(spark, monkeypatch):
    text = " ".join(random.Random(8).choices(WORDS, k=60_000))
    whole = Signer(4).shingles(text)
    monkeypatch.setattr(near_dedup, "WINDOW", 1000)
    assert (Signer(4).shingles(text) == whole).all() and len(whole) == len(shingle_set(text, 4))
    rows = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w" * 3_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(rows, shingle=4).collect()} == {1: 1, 2: 1, 3: 3}


def test_repeats_in_windows_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    shared = "".join(rng.choices("abc ", k=300))
    rows = [(i, "".join(rng.choices("abcdef", k=2000)) + shared * (i % 3) + "".join(rng.choices("abcdef", k=500))) for i in range(6)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept_sha256 int")
    data = np.frombuffer(rows[2][1].encode(), np.uint8)
    whole = suffix_dedup.winnowed(data, Rolling(), 12, 40)
    monkeypatch.setattr(suffix_dedup, "WINDOW", 97)
    assert all((x == y).all() for x, y in zip(suffix_dedup.winnowed(data, Rolling(), 12, 40), whole, strict=True))
    got = remove_repeats(frame, span=40, gram=12).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows, 40)


def test_repeats_of_thousands_of_copies(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=120))
    rows = [(i, text + hashlib.sha256(b"%d" % i).hexdigest()) for i in range(900)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span=40, gram=12).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows, 40)
