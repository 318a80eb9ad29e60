import random
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from merrow.llm.near_dedup import shingle_set
from merrow.llm.labelled import fit_logistic, held_out, training_sample
from merrow.llm.line_dedup import dedup_lines
from merrow.llm.packing import ByteTokenizer
from merrow.llm.pii import masked
from merrow.llm.quality import CompressionQuality, score_quality
from merrow.llm.toxicity import SubwordSoftmax, keep_clean, score_toxicity

from .brute import components_of

RUDE = ["idiot", "worthless", "disgusting", "pathetic"]


def texts(seed, n, bad):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeinorst", k=rng.randint(2, 8))) for _ in range(600)]
    out = []
    for i in range(n):
        words, label = rng.choices(vocabulary, k=rng.randint(8, 120)), i % 2
        out.append((bad(rng, words) if label else " ".join(words), label))
    return out


def rude(rng, words):
    for _ in range(3):
        words.insert(rng.randrange(len(words)), rng.choice(RUDE))
    return " ".join(words)


def test_toxicity_on_held_out_and_misspelt():
    model = SubwordSoftmax(epochs=8).fit(texts(1, 500, rude), 0.5)
    fresh = texts(2, 200, rude)
    right = (model.score([t for t, _ in fresh]) >= 0.5) == np.array([y == 1 for _, y in fresh])
    assert right.mean() >= 0.95
    plain = "ta ne ro is " * 10
    assert model.score([plain + "idiott worthles disgustin"])[0] > 0.5 > model.score([plain, ""]).max()


def test_quality_on_held_out():
    junk = lambda rng, words: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
    flip = lambda rows: [(t, 1 - y) for t, y in rows]
    model = CompressionQuality().fit(flip(texts(3, 600, junk)), 0.5)
    fresh = flip(texts(4, 200, junk))
    right = (model.score([t for t, _ in fresh]) >= 0.5) == np.array([y == 1 for _, y in fresh])
    assert right.mean() >= 0.95 and 0 <= model.score([""])[0] <= 1


def test_models_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, None, "p"), (2, "b", None)], "doc_id long, text string, score string")
    for model, score in ((SubwordSoftmax().fit([("a", 1)], 1.0), score_toxicity), (CompressionQuality().fit([], 0.25), score_quality)):
        rows = score(docs, model).collect()
        assert len(rows) == 3 and len({r.score for r in rows}) == 1
        assert score(docs.limit(0), model).count() == 0


def test_held_out_rule_and_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert {r.doc_id for r in docs.where(held_out()).collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) AS toxic")
    sample, share = training_sample(docs, labels, "toxic", 20, 100)
    assert len(sample) == 40 and sum(y for _, y in sample) == 20 and 0.1 < share < 0.3
    assert not {int(t.split()[1]) for t, _ in sample} & {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_logistic_curve():
    x = np.linspace(-2, 2, 400)[:, None]
    y = (x[:, 0] > 0.3).astype(int)
    w = fit_logistic(x, y, y.mean())
    assert abs(-w[1] / w[0] - 0.3) < 0.1


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(8)
    base = texts(9, 240, rude)
    line = "this long line of a licence stands in many of the documents here"
    rows = [(i, (t + "\n" + line) if i % 9 == 0 else t, "en", "s", len(t)) for i, (t, _) in enumerate(base)]
    rows += [(1000 + i, "more " + rows[2 * i][1], "en", "s", 1) for i in range(20)] + [(2000, None, None, None, None), (2001, "write to a.b@example.com now", "en", "s", 3)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(base)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in now.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            assert all(before[i] == after[i] for i in after)
            toxic = {i for i, (_, y) in enumerate(base) if y} | {1000 + i for i in range(20) if base[2 * i][1]}
            assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.05 * len(before)
        elif name == "line dedup":
            assert set(after) == set(before) and sum(line in (t or "") for t in after.values()) == 1
        elif name == "near dedup":
            assert all(before[i] == after[i] for i in after) and len(before) - len(after) >= 10
        else:
            assert after == {i: masked(t) for i, t in before.items()} and after[2001] == "write to [EMAIL] now"
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    tokens = ByteTokenizer.of(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in pieces) == sum(len(tokens.ids(t or "")) + 1 for t in after.values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)
    assert key(whole) == key(pieces)


def test_filters_keep_what_they_do_not_judge(spark):
    docs = spark.createDataFrame([(1, "a\nb", [1]), (None, None, None)], "doc_id long, text string, extra array<int>")
    model = SubwordSoftmax().fit([("a", 0)], 0.0)
    assert keep_clean(docs, model).count() == 2
    assert dedup_lines(docs).count() == 2


def test_near_stage_against_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 30, 80]))]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[: len(words) - rng.randrange(9)]))]
    rows += [(5000, None), (5001, ""), (5002, "w1 " * 200_000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, kept_id int, n_lines string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    sets = {i: shingle_set(t or "", 5) for i, t in rows}
    near = lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    first = components_of(sets, near)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i in first if first[i] == i)


def test_stages_with_clashing_names_empty_tables_and_long_texts(spark, tmp_path):
    schema = "doc_id long, text string, n_chars long, n_lines string, length string, task int, kept boolean, component_id int, score double"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c jo@x.org", 0, "x", "y", 3, True, 4, 0.5), (2, "lorem ipsum " * 150_000, 0, "x", "y", 3, True, 4, 0.5), (None, None, None, "x", "y", None, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == n
            assert n == 0 or {(r.n_lines, r.kept) for r in out.collect()} == {("x", True), ("x", None)}
        pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
        assert all(len(r.ids) == r.length for r in pieces) and len({r.doc_id for r in pieces}) == n
