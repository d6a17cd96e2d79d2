import random
import re
from collections import defaultdict

from test_dedup import brute_near, squeeze

import corpus_pipeline
from walkloom.sharedfs import materialize

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeioustrnm", k=5))
    good = [" ".join(word() for _ in range(rng.randrange(20, 90))).capitalize() + "." for _ in range(90)]
    near = [t.rsplit(" ", 2)[0] + " x." for t in good[:10] if len(t.split()) > 60]
    bad = [" ".join(word().upper() + "!!" for _ in range(40)) for _ in range(20)]
    texts = good + near + good[:8] + bad + [None]
    rows = [(i, t, "en", "abcd"[i % 4], len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(not (t or "").isupper() and bool(t)), 0) for i, t, *_ in rows]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        at[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [(r.doc_id, r.text) for r in at["quality"]]
    assert not any(t in bad for _, t in kept) and sum(t in good for _, t in kept) >= 95
    want = {}
    for i, t in kept:
        k = squeeze(t)
        want[k] = min(want.get(k, (1, 0, 0)), (-len(t or ""), i, i)) if k in want else (-len(t or ""), i, i)
    assert sorted(r.doc_id for r in at["exact_dedup"]) == sorted(v[2] for v in want.values())
    comp = brute_near([(r.doc_id, r.text) for r in at["exact_dedup"]], 5)
    assert sorted(r.doc_id for r in at["near_dedup"]) == sorted(i for i, (_, c) in comp.items() if i == c)
    size, taken = defaultdict(int), defaultdict(int)
    for r in at["near_dedup"]:
        size[r.source] += len(re.findall(r"\S+", r.text or ""))
    for r in at["mixing"]:
        taken[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - sum(size.values())) < 60 and all(taken[s] <= 3 * size[s] for s in taken)
    n = defaultdict(int)
    for r in at["packing"]:
        n[r.doc_id] += r.length
    copies = defaultdict(int)
    for r in at["mixing"]:
        copies[r.doc_id] += 1
    whole = {r.doc_id: r.doc_tokens for r in at["packing"]}
    assert all(n[i] == copies[i] * whole[i] for i in copies) and set(n) == set(copies)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, ties, an extra column, and an empty table."""
    kind = KIND + ", kept long"
    word = lambda i: f"w{i}x{i * i}"
    body = " ".join(word(i) for i in range(30))
    rows = [(1, body, "en", "a", 5, 1), (1, body, "en", "a", 5, 1), (1, body + " more", None, None, None, None), (None, body + " less", "en", "b", 1, 2), (None, None, None, None, None, None), (2, "", "en", "a", 0, 0), (3, "same", "en", "a", 1, 1), (3, "same", "en", "a", 1, 2), (4, "long " * 100_000, "en", "c", 1, 1)]
    for n, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, kind).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        docs, sizes = spark.read.parquet(f"{tmp_path}/{n}/documents.parquet"), {}
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, f"{tmp_path}/{n}"), f"odd-{name}")
            sizes[name] = docs.count()
            assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        # Six texts, white space aside; three of them are near copies.
        assert sizes["quality"] == len(some) and sizes["exact_dedup"] == (6 if some else 0) and sizes["near_dedup"] == (4 if some else 0)
        assert (sizes["packing"] > 0) == bool(some)
