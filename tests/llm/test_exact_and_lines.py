import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from merrow.llm import exact_dedup
from merrow.llm.common import Filter, Tables
from merrow.llm.exact_dedup import DigestIndex, exact_duplicates
from merrow.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, kept boolean, n long"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, True, 1) for i, t in texts], SCHEMA)


def test_exact_duplicates_small(spark):
    texts = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 100_000), (6, "a "), (7, "b" * 100_000), (None, "a"), (8, "é")]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs_of(spark, texts), keep="max").collect()}
    assert len(got) == len(texts)
    assert got[1, sha("a")] == (2, 3, False) and got[2, sha("a")] == (2, 3, True) and got[None, sha("a")] == (2, 3, False)
    assert got[3, sha("")] == (4, 2, False) and got[7, sha("b" * 100_000)] == (7, 2, True) and got[6, sha("a ")] == (6, 1, True)
    smallest = {r.doc_id: r.keep_id for r in exact_duplicates(docs_of(spark, texts), keep="min").collect()}
    assert smallest[2] == 1 and smallest[4] == 3


def test_exact_duplicates_repeated_rows_and_empty(spark):
    got = exact_duplicates(docs_of(spark, [(1, "a"), (1, "a"), (2, "c")])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 2, True), (1, 2, True), (2, 1, True)]
    assert exact_duplicates(docs_of(spark, [])).count() == 0


def brute_lines(texts, least_chars, least_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or i == max(holders[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_against_brute_force(spark):
    common = "This Line is common É to many"
    texts = [
        (1, f"{common}\nown one\n{common}"), (2, f"  {common.lower().replace('é', 'É')}\t"), (3, f"x\n{common}\n\n"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"),
        (9, common.replace("É", "é")), (10, "\n".join([common] * 3000)), (11, "\x0b" + common + "\xa0"),
    ]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs_of(spark, texts).drop("n"), 20, 3).collect()}
    assert got == brute_lines(texts, 20, 3)
    assert got[10][1] == 0 and got[1] == (3, 2, "own one")


def test_lines_keep_other_columns_and_empty_tables(spark):
    assert dedup_lines(docs_of(spark, [(1, "a")])).columns[:3] == ["doc_id", "kept", "n"]
    assert dedup_lines(docs_of(spark, [])).count() == 0


def test_groups_of_thousands_and_clashing_digests(spark, monkeypatch):
    texts = [(i, "same text") for i in range(1500)] + [(5000 + i, f"own {i}") for i in range(300)]
    got = exact_duplicates(docs_of(spark, texts), keep="max").collect()
    assert len(got) == 1800 and all((r.keep_id, r.group_size) == ((1499, 1500) if r.doc_id < 5000 else (r.doc_id, 1)) for r in got)
    # all digests alike: the bytes decide
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.concat(F.lit("x"), F.substring(column, 1, 0)))
    small = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_duplicates(docs_of(spark, small)).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_index_over_many_flushes(spark):
    index = DigestIndex(Tables(spark, "test"))
    for k in range(9):
        index.flush(spark.range(k * 10, k * 10 + 15).selectExpr("sha2(cast(id % 40 as string), 256) AS digest", f"{k} * 1000 + id AS id"))
    assert sorted(map(len, index.tiers.values())) == [1, 2]
    asked = spark.range(60).selectExpr("id AS mine", "sha2(cast(id as string), 256) AS digest")
    got = {r.mine: (r.keep_id, r.n) for r in index.lookup(asked).collect()}
    want = {}
    for k in range(9):
        for i in range(k * 10, k * 10 + 15):
            least, n = want.get(i % 40, (1 << 60, 0))
            want[i % 40] = min(least, k * 1000 + i), n + 1
    assert got == want


def test_filter_lets_all_members_through_and_few_others(spark):
    digests = spark.range(3000).selectExpr("sha2(cast(id as string), 256) AS digest")
    made = Filter(Tables(spark, "test"), digests, "digest")
    assert made.probe(digests).count() == 3000
    assert made.probe(spark.range(10_000, 13_000).selectExpr("sha2(cast(id as string), 256) AS digest", "id")).count() < 600
    assert Filter(Tables(spark, "test"), digests.limit(0), "digest").probe(digests).count() == 0


def test_lines_of_thousands_of_documents_clashing_names_and_modes(spark):
    texts = [(i, f"A very common line of this corpus\nown line of document {i}") for i in range(1200)] + [(2000, "x" * 2_000_000 + "\ny")]
    frame = spark.createDataFrame([(i, t, 9, 9, "q") for i, t in texts], "doc_id long, text string, n_lines int, n_dropped int, _lines string")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            out = dedup_lines(frame, 20, 5)
            assert out.columns == ["doc_id", "_lines", "text", "n_lines", "n_dropped"]
            got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        assert got == brute_lines(texts, 20, 5)
