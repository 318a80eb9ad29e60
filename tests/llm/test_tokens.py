import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from merrow.llm.bpe import Bpe, Decoder, Spaced, encode_documents, sufficient_lookahead
from merrow.llm.packing import ByteTokenizer, Planner, pack

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = Bpe.of(WORD)
    assert mine.ids(text) == ids
    assert " ".join(d for _, texts in mine.pieces(text) for d in texts) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abeinorst ABCÉéß'sdm12 \n\t!?-<|>中ñ", max_size=60))
def test_ids_as_the_library(text):
    same(_library(), text)


_made = []


def _library():
    if not _made:
        _made.append(Tokenizer.from_file(WORD))
    return _made[0]


def test_long_words_stream(library):
    rng = random.Random(4)
    assert Bpe.of(WORD).lookahead < Bpe.of(WORD).window
    for parts, n in (("aeinorsth", 4000), (["the", "ing", "an", "tion", "q"], 1500), ("a", 5000), ("!", 3000)):
        same(library, "".join(rng.choices(parts, k=n)))
    for text in ["<|startoftext|>a<|endoftext|> b'S", "ΣΑΣ ΟΔΟΣ", "", "  ", "é́ 가 ½ ² ٣", "x\x1cy\x85z"]:
        same(library, text)


def test_every_word_goes_through_the_transducer_and_the_decoder(monkeypatch):
    words, fed = [], []
    stream, token = Bpe.stream, Decoder.token
    monkeypatch.setattr(Bpe, "stream", lambda self, symbols: stream(self, words.append(1) or symbols))
    monkeypatch.setattr(Decoder, "token", lambda self, i: fed.append(i) or token(self, i))
    bpe = Bpe(WORD)
    ids = bpe.ids("the cat sat on the unbelievable mat " + "q" * 5000)
    assert len(words) == 7 and fed.count(bpe.vocab["cat</w>"]) == 1 and set(fed) == set(ids)


def test_long_texts_in_constant_memory(library):
    text = "the quick brown fox, jumped over 12 lazy dogs " * 170_000
    bpe = Bpe(WORD)
    ids, decoded = Spaced(False), Spaced(False)
    tracemalloc.start()
    for some_ids, some_text in bpe.pieces(text):
        ids.put(some_ids)
        decoded.put(some_text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000 < 2 * len(text) + 10_000_000
    few = library.encode(text[: 46 * 3], add_special_tokens=False).ids
    assert ids.spaces + 1 == len(few) // 3 * 170_000
    assert ids.digest.hexdigest() == hashlib.sha256(" ".join(map(str, few[: len(few) // 3] * 170_000)).encode()).hexdigest()


def test_lookahead_of_a_chain():
    assert sufficient_lookahead([("a", "b")]) == 2
    assert sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 4


def test_decoded_text_restores_words():
    bpe = Bpe.of(WORD)
    assert "".join(bpe.decoded_text(bpe.ids("héllo wörld 日本"))).strip() == "héllo wörld 日本"


def test_encode_documents_rows(spark):
    docs = spark.createDataFrame([(1, "the cat", 5), (2, None, 5), (3, "", 5), (3, "x" * 5000, 5)], "doc_id long, text string, n_tokens int")
    rows = encode_documents(docs, WORD, with_ids=True).collect()
    assert len(rows) == 4 and {r.n_tokens for r in rows if r.ids == []} == {0}
    assert encode_documents(docs.limit(0), WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50))
def test_byte_ids_as_the_library(text):
    tokens = ByteTokenizer.of(BYTE)
    assert tokens.ids(text) == tokens.library.encode(text, add_special_tokens=False).ids


def test_planner_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(20):
        capacity = rng.choice([16, 64, 257])
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
        plan = Planner(counts, capacity).run()
        got = {}
        for pattern, times in plan:
            assert sum(pattern) <= capacity
            for length in pattern:
                got[length] = got.get(length, 0) + times
        assert got == counts
        bound = -(-sum(k * n for k, n in counts.items()) // capacity)
        assert sum(t for _, t in plan) <= bound * 1.2 + 1


def test_pack_is_gapless_and_complete(spark):
    texts = [(1, "the cat sat on the mat " * 30), (2, None), (3, ""), (4, "word " * 700), (5, "a b c"), (5, "a b c"), (6, "<|endoftext|> é 日本")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts], "doc_id long, text string, length int")
    rows = pack(docs, BYTE, capacity=64, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    tokens = ByteTokenizer.of(BYTE)
    for i, t in texts:
        if i != 5:
            mine = sorted((r.piece, r.start, r.ids) for r in rows if r.doc_id == i)
            ids = [*tokens.ids(t or ""), 2]
            assert [x for _, _, part in mine for x in part] == ids
            assert all(len(part) == 64 for _, _, part in mine[1:]) and [s for _, s, _ in mine] == [0, *range(len(mine[0][2]), len(ids), 64)]
    assert len([r for r in rows if r.doc_id == 5]) == 2
    assert pack(docs.limit(0), BYTE).count() == 0


def test_long_runs_of_one_kind_through_spark(spark):
    from merrow.llm.packing import pieces_of

    byte = Tokenizer.from_file(BYTE)
    texts = [" " * 2_000_000, "\n" * 2_000_000, "\t" * 500_000, "ab" * 1_000_000, "word " * 3 + "\r\n " * 200_000 + "end", "x" * 4096 + " " * 4096 + "y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in pieces_of(docs, BYTE, 1024, 2, False).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*byte.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            assert got.pop((i, piece)) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert not got


def test_no_more_sequences_than_best_fit_decreasing():
    from bisect import bisect_left, insort
    from collections import Counter

    rng = random.Random(6)
    for shape in range(12):
        lengths = [min(256, max(1, int(rng.choice([rng.expovariate(1 / 40), rng.gauss(90, 20), rng.uniform(1, 256)][: 1 + shape % 3])))) for _ in range(60 * (shape + 1))]
        gaps, plain = [], 0
        for length in sorted(lengths, reverse=True):
            at = bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else 256
            plain += gap == 256
            if gap > length:
                insort(gaps, gap - length)
        plan = Planner(Counter(lengths), 256).run()
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 256
            for length in pattern:
                used[length] += times
        assert used == Counter(lengths)
        assert sum(times for _, times in plan) <= plain + (plain > 200)
