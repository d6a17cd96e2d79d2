"""What the joins and explodes of near-dedup make on groups that share a passage without being links."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import brute_near, docs
from walkloom.llm.near_dup import by_size, near_duplicates, prefixes


def runs(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def made(spark, since):
    """Rows made by each join and explode in the SQL runs after the first `since`."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    for i in range(since, store.executionsCount()):
        run = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for n in map(nodes.apply, range(nodes.size())):
            for x in map(n.metrics().apply, range(n.metrics().size())):
                if x.name() == "number of output rows" and ("Join" in n.name() or n.name() == "Generate") and values.contains(x.accumulatorId()):
                    out[n.desc()] = out.get(n.desc(), 0) + int(values.apply(x.accumulatorId()).replace(",", ""))
    return out


def around_a_passage(n, seed=5):
    """n texts of a passage of 60 words and 85 others, some with a near copy; the passage alone; lone texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    passage, rows = [word() for _ in range(60)], []
    for i in range(n):
        w = [word() for _ in range(40)] + passage + [word() for _ in range(45)]
        rows.append(w)
        if i % 20 == 0:
            w = list(w)
            for _ in range(5):
                w[rng.randrange(len(w))] = word()
            rows.append(w)
    rows += [passage, [word(), *passage], *[[word() for _ in range(30)] for _ in range(n)]]
    return list(enumerate(" ".join(w) for w in rows))


def test_rows_around_a_passage(spark):
    rows, since = around_a_passage(200), runs(spark)
    got = near_duplicates(docs(spark, rows), k=2)
    got = {r.id: r.component_id for r in got.collect()}
    assert got == {i: c for i, (_, c) in brute_near(rows, 2).items()}
    rows_of = made(spark, since)
    outside = [v for k, v in rows_of.items() if "explode(outside" in k or "explode(head" in k]
    print("rows of explodes outside the pivot:", outside)
    assert outside and max(outside) < 200 * 85 // 2
    bands = next(v for k, v in rows_of.items() if "explode(bands" in k)
    buckets = max(v for k, v in rows_of.items() if "Join [bucket" in k)
    print("rows of bands and of the largest join on buckets:", bands, buckets)
    assert buckets < bands // 2


@pytest.mark.parametrize("heavy", [2000, 4, 1])
def test_by_size_is_a_join(spark, heavy):
    rows = spark.range(4000).select(F.when(F.col("id") < 500, 7).when(F.col("id") % 9 > 0, F.col("id") % 40).cast("long").alias("key"), F.col("id").alias("name"))
    info = rows.filter("key < 20").groupBy("key").agg(F.count("*").alias("m"), (-F.min("name")).alias("v"))
    want = sorted(map(tuple, rows.join(info, "key").select("key", "name", "m", "v").collect()))
    assert sorted(map(tuple, by_size(rows, info, "key", "m", "v", heavy=heavy).collect())) == want
    binary = lambda d: d.withColumn("key", F.col("key").cast("string").cast("binary"))
    assert by_size(binary(rows), binary(info), "key", "m", "v", heavy=heavy).count() == len(want)


@pytest.mark.parametrize("sample", [1, 8, 1000])
def test_prefixes_meet_whatever_the_sample(spark, sample):
    """Members with as many shared shingles as both prefixes ask for meet in their heads, for every sample."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        s = sorted({rng.randrange(12) for _ in range(6)} | {1000 * (i // 2) + rng.randrange(8) for _ in range(6)} | {-i})
        rows.append((b"p%d" % (i % 3), b"c%d" % i, b"r", rng.randrange(1, len(s) + 1), s))
    frame = spark.createDataFrame(rows, "pivot binary, cid binary, root binary, prefix long, outside array<long>")
    head = {bytes(r.cid): set(r["head"]) for r in prefixes(frame, sample).collect()}
    met = 0
    for n, (p, a, _, x, s) in enumerate(rows):
        assert head[a] <= set(s) and len(head[a]) <= x
        for q, b, _, y, t in rows[n + 1 :]:
            if p == q and len(set(s) & set(t)) >= max(len(s) - x, len(t) - y) + 1:
                met += 1
                assert head[a] & head[b]
    assert met
