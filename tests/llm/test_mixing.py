import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from walkloom.llm.mixing import fit_budget, mix, take_mix

KIND = "doc_id long, text string, source string, lang string"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Excess over a ceiling goes to the others by weight until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, ws = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        over = {s: most * sizes[s] for s in names if s not in fixed and left * w[s] / ws > most * sizes[s]}
        if not over:
            return fixed | {s: left * w[s] / ws for s in names if s not in fixed}
        fixed |= over


def rows(n=400):
    out = [(i, " ".join(["w"] * (i * 7 % 90)), ["a", "b", "B", "z", None][i % 5 if i % 2 else 0], "en") for i in range(n)]
    return out + [(n, None, "a", "en"), (n + 1, "", "e", "en"), (None, "x y", "b", "en"), (5, "x y z", "b", "en"), (5, "x y z", "b", "en")]


def test_mix_hits_targets(spark):
    data = rows()
    got = mix(spark.createDataFrame(data, KIND), bucket_rows=50, dp_words=200).collect()
    assert len(got) == len(data)
    size = defaultdict(int)
    for _, t, s, _ in data:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(dict(size)), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 1.5 for s in want)
    again = mix(spark.createDataFrame(data[::-1], KIND).repartition(3), bucket_rows=50, dp_words=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_take_mix_repeats_rows(spark):
    df = spark.createDataFrame(rows(60), KIND)
    plan = mix(df).collect()
    out = take_mix(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in plan)


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert mix(df).count() == 0 and take_mix(df).count() == 0
    none = spark.createDataFrame([(1, None, None, None), (2, " ", "s", "x")], KIND)
    assert {r.copies for r in mix(none).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 120))
def test_subset_sum_is_nearest(histogram, budget):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[n] for n in lengths.tolist()])
    take = fit_budget(lengths, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    sums = {sum(n * k for n, k in zip(lengths.tolist(), c, strict=True)) for c in itertools.product(*[range(k + 1) for k in counts.tolist()])}
    assert abs(int((lengths * take).sum()) - budget) == min(abs(s - budget) for s in sums)


@pytest.mark.parametrize("budget", [10_000, 777_777, 1_234_567])
def test_large_budgets(budget):
    lengths = np.arange(1, 2000)
    counts = np.full(len(lengths), 7)
    assert int((lengths * fit_budget(lengths, counts, budget, dp_words=4096)).sum()) == budget
