import gzip
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merrow.functions.draws import draw
from merrow.operators import catalog, cf, clean, factors, fusion, ids, kcore, leakage, metrics, provenance, split, stats, text, vectors
from merrow.operators.stemming import porter
from merrow.sources import interactions as src
from merrow.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# a small world: events by user and item, targets, and what follows from them by hand
EVENTS = [("u1", 0), ("u2", 0), ("u2", 1), ("u2", 4), ("u2", 5), ("u3", 0), ("u3", 1), ("u3", 2), ("u3", 4), ("u3", 5), ("u4", 0), ("u4", 1), ("u4", 4)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(EVENTS, "user_id string, item long")


def test_popularity_order(pairs):
    assert [r.item for r in cf.popularity(pairs).orderBy("place").collect()] == [0, 1, 4, 5, 2]


def test_item_cosine_by_hand(pairs):
    sim = {(r.item, r.neighbor): r.sim for r in cf.item_cosine(pairs).collect()}
    assert sim[0, 1] == sim[1, 0] == round(3 / math.sqrt(4 * 3), 9) and sim[1, 4] == 1.0 and (0, 0) not in sim
    assert sim[2, 5] == round(1 / math.sqrt(2), 9)


def test_knn_orientations_differ(pairs):
    near = cf.top_neighbors(cf.item_cosine(pairs), 1)
    history = pairs.where("user_id = 'u1'")
    assert {r.item for r in cf.knn_scores(history, near).collect()} == {1}
    assert rows(cf.knn_scores(history, near, "matrix")) == []


def test_fill_topk_by_signal(spark, pairs):
    users = spark.createDataFrame([("u1",), ("new",)], "user_id string")
    scores = spark.createDataFrame([("u1", 4, 1.0), ("u1", 0, 2.0)], "user_id string, item long, score double")
    seen = pairs.where("user_id = 'u1'")
    got = rows(cf.fill_topk(scores, users, seen, cf.popularity(pairs), 3))
    assert got == [("new", 0, 1), ("new", 1, 2), ("new", 4, 3), ("u1", 1, 2), ("u1", 2, 3), ("u1", 4, 1)]
    popular = rows(cf.fill_popular(scores, users.where("user_id = 'u1'"), seen, cf.popularity(pairs), 3))
    assert popular == [("u1", 1, 2), ("u1", 4, 1), ("u1", 5, 3)]


def test_ranking_metrics_by_hand(spark):
    recs = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("a", 12, 3), ("b", 10, 1)], "user_id string, item long, rank int")
    targets = spark.createDataFrame([("a", 11), ("a", 12), ("a", 99), ("b", 5), ("c", 10)], "user_id string, item long")
    got = {r.user_id: r for r in metrics.ranking_metrics(recs, targets, 3).collect()}
    a = got["a"]
    assert (a.precision, a.recall, a.hit_rate, a.mrr) == (round(2 / 3, 6), round(2 / 3, 6), 1.0, 0.5)
    ideal = sum(1 / math.log2(r + 1) for r in (1, 2, 3))
    assert a.ndcg == round((1 / math.log2(3) + 1 / math.log2(4)) / ideal, 6) and a.map == round((1 / 2 + 2 / 3) / 3, 6)
    assert got["b"].ndcg == got["c"].recall == 0.0 and len(got) == 3


def test_loss_decomposition_adds_up(spark):
    rng = random.Random(1)
    pool = [(f"u{u}", i) for u in range(6) for i in rng.sample(range(40), 20)]
    recs = [(u, i, r + 1) for u in {p[0] for p in pool} for r, i in enumerate([x[1] for x in pool if x[0] == u][:10])]
    targets = [(f"u{u}", i) for u in range(6) for i in rng.sample(range(40), 15)]
    make = lambda data, ddl: spark.createDataFrame(data, ddl)
    row = metrics.loss_decomposition(make(pool, "user_id string, item long"), make(recs, "user_id string, item long, rank int"), make(targets, "user_id string, item long")).first()
    assert abs(row.retrieval_loss + row.capacity_loss + row.ranking_loss + row.recall - 1) < 1e-5


def test_rrf_and_round_robin(spark):
    lists = spark.createDataFrame([("u", "a", 1, 7), ("u", "a", 2, 8), ("u", "b", 1, 8), ("u", "b", 2, 9)], "user_id string, source string, rank int, item long")
    assert [r.item for r in fusion.rrf(lists).orderBy("rank").collect()] == [8, 7, 9]
    assert [r.item for r in fusion.round_robin(lists, ["a", "b"], 3).orderBy("rank").collect()] == [7, 8, 9]
    with pytest.raises(ValueError):
        fusion.quota_merge(lists, {"a": 3, "b": 3}, 5)


def test_clean_counts_reasons_in_order(spark):
    data = [("u", "i", 5, 10**12, 0), (None, "i", 9, 5, 1), ("u", "i", 9, 5, 2), ("u", "i", 9, 10**12, 3), ("u", "i", 4, 10**12, 4)]
    df = spark.createDataFrame(data, "user_id string, parent_asin string, rating int, ts long, source_seq int")
    report = clean.clean_report(df).first()
    assert (report.input_rows, report.dropped_missing, report.dropped_timestamp, report.dropped_rating, report.dropped_duplicates, report.output_rows) == (5, 1, 1, 1, 1, 1)
    assert clean.clean(df, ["source_seq"]).first().rating == 4
    with pytest.raises(ValueError):
        clean.assert_rate(df, 0.01)


def brute_core(events, k):
    for _ in range(20):
        users, items = Counter(u for u, _ in events), Counter(i for _, i in events)
        kept = [(u, i) for u, i in events if users[u] >= k and items[i] >= k]
        if len(kept) == len(events):
            return kept
        events = kept
    return events


def test_k_core_against_brute_force(spark):
    rng = random.Random(3)
    events = [(f"u{rng.randrange(30)}", f"i{rng.randrange(25)}") for _ in range(150)]
    df = spark.createDataFrame(events, "user_id string, parent_asin string")
    assert rows(kcore.k_core(df, 3, 3)) == sorted(brute_core(events, 3))
    assert rows(kcore.k_core_pairs(df, 3, 3)) == sorted(brute_core(sorted(set(events)), 3))
    with pytest.raises(RuntimeError):
        kcore.k_core_pairs(df, 3, 3, most=0)


def test_dense_ids(spark):
    df = spark.createDataFrame([("b", 2), ("a", 5), ("c", 1), ("b", 9)], "key string, pos int")
    assert rows(ids.build_ids(df, "key", ["pos"])) == [("a", 2), ("b", 1), ("c", 0)]
    assert rows(ids.build_sorted_ids(df, "key")) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(Exception, match="no user_idx"):
        users, items = ids.build_sorted_ids(df.where("key <> 'c'"), "key").withColumnRenamed("key", "user_id"), ids.build_sorted_ids(df, "pos").withColumnRenamed("pos", "parent_asin")
        ids.apply_ids(df.selectExpr("key AS user_id", "pos AS parent_asin"), users, items).collect()


def test_cutoffs_are_order_statistics(spark):
    rng = random.Random(5)
    times = [rng.randrange(10**9) * 100 for _ in range(200)] + [77] * 9
    df = spark.createDataFrame([(t,) for t in times], "ts long")
    ordered = sorted(times)
    assert split.temporal_cutoffs(df) == (ordered[int(209 * 0.8) - 1], ordered[int(209 * 0.9) - 1])
    with pytest.raises(ValueError):
        split.temporal_cutoffs(df.limit(0))


def test_leak_checks_both_ways(spark):
    good = spark.createDataFrame([("train", 1, "a"), ("validation", 2, "b"), ("test", 3, "c")], "split string, ts long, user_id string")
    bad = spark.createDataFrame([("train", 9, "a"), ("validation", 2, "a"), ("test", 3, "c")], "split string, ts long, user_id string")
    assert leakage.check_order(good).first().ok and not leakage.check_order(bad).first().ok
    assert leakage.check_overlap(good, ["user_id"]).first().ok and leakage.check_overlap(bad, ["user_id"]).first().train_validation == 1
    assert not leakage.check_order(good.where("split <> 'test'")).first().ok
    with pytest.raises(ValueError):
        leakage.require(leakage.check_order(bad))
    twice = good.unionByName(good)
    assert leakage.check_subset(good, twice, ["ts"]).first().extra_rows == 3 and leakage.check_subset(twice, good, ["ts"]).first().ok


def test_filters_reject_nonsense():
    for spec in ({"colour": "red"}, {"price_min": 2, "price_max": 1}, {"title_contains": "a\0"}):
        with pytest.raises(ValueError):
            catalog.predicate(spec)
    with pytest.raises(ValueError):
        catalog.predicate({"domain": "X"}, ["A"])


def test_filters_fold_ascii_only(spark):
    df = spark.createDataFrame([("1", "Über"), ("2", "über"), ("3", "ÜBER 100%_\\")], "item_id string, title string")
    found = lambda needle: [r.item_id for r in catalog.apply_filters(df, {"title_contains": needle}).orderBy("item_id").collect()]
    assert found("ÜBE") == ["1", "3"] and found("%_\\") == ["3"] and found("") == ["1", "2", "3"]


def test_coerced_numbers(spark):
    texts = ["$1,234.50", "NaN", "1.0d", "", None, " 7 ", "1e3", "abc", "-2"]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select(catalog.coerced("p").alias("n"))
    assert [r.n for r in df.collect()] == [1234.5, None, None, None, None, 7.0, 1000.0, None, -2.0]


def test_category_suggestions(spark):
    vocabulary = spark.createDataFrame([("Video Games",), ("Video",), ("Toys",)], "category string")
    wanted = spark.createDataFrame([("Toys",), ("vIDEO",), ("Vidoe Games",), ("zzz",)], "category string")
    got = {r.category: r for r in catalog.resolve_categories(wanted, vocabulary).collect()}
    assert got["Toys"].resolved == "Toys" and got["vIDEO"].resolved == "Video" and got["Vidoe Games"].resolved is None
    assert got["Vidoe Games"].suggestions[0] == "Video Games" and got["zzz"].suggestions is None


def test_query_tokens(spark):
    df = spark.createDataFrame([("USB-C 4k the 2025 café USB-C x",), (None,)], "q string")
    got = [r.t for r in df.select(text.tokenize_query("q").alias("t")).collect()]
    assert got[0] == ["usb-c", "4k", "cafe"] and got[1] is None
    folded = [r.t for r in spark.createDataFrame([("Café™ “x”  – 中 y",)], "q string").select(text.ascii_fold("q").alias("t")).collect()]
    assert folded == ['Cafe "x" - y']


def test_porter_on_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll"}
    assert {w: porter(w) for w in pairs} == pairs


def test_hash_embedding_is_the_digest_rule(spark):
    import hashlib

    row = vectors.hash_embed(spark.createDataFrame([("1", "Red red shoe"), ("2", "")], "item_id string, text string"), 16).orderBy("item_id").collect()
    want = [0.0] * 16
    for w in ("red", "red", "shoe"):
        h = hashlib.sha256(w.encode()).digest()
        want[int.from_bytes(h[:4], "little") % 16] += 1.0 if h[4] % 2 == 0 else -1.0
    size = math.sqrt(sum(x * x for x in want))
    assert all(abs(a - b / size) < 1e-9 for a, b in zip(row[0].vec, want, strict=True)) and set(row[1].vec) == {0.0}


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).withColumn("x", (F.col("id") % 10).cast("double"))
    r = stats.bootstrap_ci(df, "x", "id").first()
    assert r.low < r.mean == 4.5 < r.high and r.high - r.low < 1.2
    p = stats.paired_bootstrap(df.withColumn("y", F.col("x") + 1), "x", "y", "id").first()
    assert (p.low, p.high, p.p_value, p.improved, p.worse) == (1.0, 1.0, 0.0, 400, 0)


def test_poisson_draws(spark):
    w = spark.range(20_000).select(stats.poisson_one(draw(F.col("id"), F.lit(1))).alias("w"))
    m, v = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.06


def test_gates_and_regression(spark):
    make = lambda d: spark.createDataFrame(d, "metric string, value double")
    bounds = spark.createDataFrame([("a", 0.5, None), ("b", None, 1.0)], "metric string, low double, high double")
    assert stats.gate_passed(stats.gate(make([("a", 0.6), ("b", 0.2)]), bounds)).first().passed is True
    assert stats.gate_passed(stats.gate(make([("a", 0.1), ("b", 0.2)]), bounds)).first().passed is False
    assert stats.gate_passed(stats.gate(make([("a", 0.6)]), bounds)).first().passed is None
    got = {r.metric: r.status for r in stats.regression(make([("a", 1.0), ("t", 2.0), ("x", 1.0)]), make([("a", 1.2), ("t", 2.02), ("y", 1.0)]), ["t"]).collect()}
    assert got == {"a": "improved", "t": "neutral", "x": "removed", "y": "new"}


def test_fingerprints_ignore_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    a, b = provenance.fingerprint(df).first(), provenance.fingerprint(df.orderBy(F.desc("id")).select("x", "id")).first()
    assert a == b != provenance.fingerprint(df.withColumn("x", F.col("x") + 1)).first()


def test_triples_and_loss(spark, pairs):
    triples = factors.sample_triples(pairs, 0).collect()
    seen = set(EVENTS)
    assert len(triples) == len([e for e in EVENTS if e[0] != "u3"]) and all((t.user_id, t.negative) not in seen for t in triples)
    users, items, losses = factors.bpr_fit(pairs, dim=4, epochs=3)
    assert losses[-1] < losses[0]
    top = factors.factor_topk(users, items, pairs, 2).collect()
    assert all((r.user_id, r.item) not in seen for r in top) and {r.user_id for r in top} == {"u1", "u2", "u4"}


def test_reviews_and_splits_round_trip(spark, tmp_path):
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        for i in range(50):
            f.write(json.dumps({"user_id": f"u{i % 7}", "parent_asin": f"A{i}", "rating": None if i == 3 else 4, "timestamp": 10**12 + i, "other": 1}) + "\n")
    df = src.read_reviews(spark, str(tmp_path / "r.jsonl.gz"))
    assert df.count() == 50 and df.where("rating IS NULL").count() == 1
    tagged = src.tag_domain(df, "Toys")
    assert tagged.where("parent_asin = 'Toys::A1' AND original_item_id = 'A1'").count() == 1
    parts = tagged.drop("source_seq").withColumn("split", F.when(F.col("timestamp") % 2 == 0, "train").otherwise("test"))
    src.save_splits(parts, str(tmp_path / "s"))
    assert src.load_splits(spark, str(tmp_path / "s"), ["user_id", "absent"], ["train"]).count() == 25
    with pytest.raises(Exception, match="exists|EXISTS"):
        src.save_splits(parts, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        src.merge_domains([df])


def test_metadata_of_kept_items_only(spark, tmp_path):
    for domain, ids_ in (("A", ["x", "y"]), ("B", ["x"])):
        (tmp_path / f"{domain}.jsonl").write_text("\n".join(json.dumps({"parent_asin": i, "title": f"{domain}{i}", "price": "3", "categories": ["c"], "extra": 1}) for i in ids_))
    keep = spark.createDataFrame([("x", "A"), ("x", "A"), ("x", "B")], "parent_asin string, domain string")
    files = {d: str(tmp_path / f"{d}.jsonl") for d in "AB"}
    assert src.read_metadata(spark, files).count() == 3
    assert rows(src.read_metadata(spark, files, keep).select("domain", "parent_asin", "title")) == [("A", "x", "Ax"), ("B", "x", "Bx")]


def test_model_round_trip_is_checked(spark, pairs, tmp_path):
    provenance.save_model(pairs, str(tmp_path / "m"), {"k": "2"})
    assert rows(provenance.load_model(spark, str(tmp_path / "m"), {"k": "2"})) == rows(pairs)
    with pytest.raises(ValueError):
        provenance.load_model(spark, str(tmp_path / "m"), {"k": "3"})


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    data = [(f"u{rng.randrange(5)}", f"i{rng.randrange(4)}", rng.choice([1, 5, 9]), 10**12 + rng.randrange(6), i) for i in range(80)]
    df = spark.createDataFrame(data, "user_id string, parent_asin string, rating int, ts long, source_seq int")
    df.repartitionByRange(3, "source_seq").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = jobs.run_once(jobs.stream_first_seen(stream), "complete", f"file://{tmp_path}/a")
    assert rows(seen) == rows(src.first_seen(df))
    timed = stream.withColumn("event_time", F.timestamp_millis("ts"))
    kept = jobs.run_once(jobs.stream_clean(timed), "append", f"file://{tmp_path}/b")
    assert rows(kept.select(*clean.KEY)) == rows(clean.clean(df, ["source_seq"]).select(*clean.KEY))


def test_plans_have_no_products_of_tables(spark, pairs):
    for df in (cf.item_cosine(pairs), cf.knn_scores(pairs, cf.item_cosine(pairs)), metrics.ranking_metrics(pairs.withColumn("rank", F.lit(1)), pairs, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
