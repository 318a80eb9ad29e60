"""k-core by frontier: the same rows as filtering round by round, at any limit, and work in proportion to what drops."""

import random
import warnings
from collections import Counter

import pytest

from merrow.functions.storage import Scratch
from merrow.operators import kcore


def plain(events, k_user, k_item, most, same=lambda e: None):
    for _ in range(most):
        users, items = Counter((same(e), e[0]) for e in events), Counter((same(e), e[1]) for e in events)
        kept = [e for e in events if e[0] is not None and e[1] is not None and users[same(e), e[0]] >= k_user and items[same(e), e[1]] >= k_item]
        if len(kept) == len(events):
            return events
        events = kept
    return events


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_same_rows_at_any_limit_with_nulls_and_repeats(spark):
    rng = random.Random(4)
    for k_user, k_item, most in ((2, 3, 1), (3, 2, 2), (3, 3, 3), (2, 2, 20), (9, 9, 20), (1, 1, 20)):
        events = [(rng.choice([None, *[f"u{i}" for i in range(25)]]), rng.choice([None, *[f"i{i}" for i in range(30)]]), j % 2) for j in range(110)]
        df = spark.createDataFrame(events, "user_id string, parent_asin string, domain int")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert rows_of(kcore.k_core(df, k_user, k_item, most)) == sorted(plain(events, k_user, k_item, most), key=str)
            parted = rows_of(kcore.k_core(df, k_user, k_item, most, within=["domain"]))
        assert parted == sorted(plain(events, k_user, k_item, most, lambda e: e[2]), key=str)
    assert kcore.k_core(df.where("false"), 2, 2).count() == 0


def chain(n):
    """A path that loses its end in each round, beside a block that stays."""
    path = [(f"p{i}", f"q{i}") for i in range(n)] + [(f"p{i + 1}", f"q{i}") for i in range(n)]
    return path + [(f"u{i}", f"v{j}") for i in range(40) for j in range(40)]


def test_rounds_write_in_proportion_to_what_drops(spark, monkeypatch):
    written, stored = [], Scratch.stored

    def counted(self, df, label):
        out = stored(self, df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(Scratch, "stored", counted)
    df = spark.createDataFrame(chain(5), "user_id string, parent_asin string")
    assert rows_of(kcore.k_core(df, 2, 2)) == sorted((u, v) for u, v in chain(5) if u[0] == "u")
    rounds = [n for label, n in written if label in ("frontier", "taken")]
    assert sum(rounds) <= 4 * 11 and [n for label, n in written if label == "edges"] == [1610]


def test_limit_of_rounds(spark):
    df = spark.createDataFrame(chain(4), "user_id string, parent_asin string")
    with pytest.warns(UserWarning, match="not converged"):
        kcore.k_core(df, 2, 2, most=2)
    with pytest.raises(RuntimeError):
        kcore.k_core_pairs(df, 2, 2, most=2)
    assert kcore.k_core_pairs(df, 2, 2).count() == 1600
