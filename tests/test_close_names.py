"""Close names by matching ratio against the standard library's."""

import difflib
import random

from merrow.operators import catalog


def test_close_names_are_those_of_difflib(spark):
    rng = random.Random(2)
    known = {"".join(rng.choices("abcdeé 🎉", [9, 5, 4, 3, 3, 1, 2, 1], k=rng.randint(1, 12))) for _ in range(150)} | {"Home & Kitchen", "Kitchen", "Home"}
    wanted = {"".join(rng.sample(k, len(k)))[: rng.randint(1, 12)] for k in rng.sample(sorted(known), 60)} | {"Home Kitchen", "kitchn", "zzz", ""}
    asked = spark.createDataFrame([(w,) for w in wanted], "category string")
    names = spark.createDataFrame([(k,) for k in known], "known string")
    for least, most in ((0.6, 5), (0.85, 2)):
        got = {}
        for r in catalog.close_names(asked, names, least, most).orderBy("category", "rank").collect():
            got.setdefault(r.category, []).append(r.known)
        want = {w: found for w in wanted if (found := difflib.get_close_matches(w, known, most, least))}
        assert got == want
    assert catalog.close_names(asked, names.where("false")).count() == 0
