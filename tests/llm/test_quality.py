import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from walkloom.llm.quality import PairwiseRanker, features, keep_good, quality_scores

KIND = "doc_id long, text string, score string"


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioustrnm", k=rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 120))]
        bad = i % 6 == 0
        text = " ".join(x + rng.choice(["$$$", "###", "!!"]) for x in w) if bad else " ".join(w).capitalize() + "."
        rows.append((i, text, "clash"))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = quality_scores(spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = {i: q for i, q, _ in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.accepted == (r.score >= 0.7)
    out = [r for r in got if r.held_out]
    assert sum(r.accepted == bool(good[r.id]) for r in out) / len(out) > 0.97


def test_held_out_labels_do_not_teach(spark):
    rows, labels = corpus(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    docs = spark.createDataFrame(rows, KIND)
    a, b = (sorted((r.id, r.score) for r in quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    rows, labels = corpus(120)
    odd = [(None, None, None), (7, "", ""), (7, "x", ""), (8, " \n ", None), (9, "w" * 100_000, "")]
    none = [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0)]
    docs = spark.createDataFrame(rows + odd, KIND)
    kept = keep_good(docs, spark.createDataFrame(labels + none, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and 60 < kept.count() < 125
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert keep_good(docs, no_labels).count() == docs.count()
    assert quality_scores(docs.limit(0), no_labels).count() == 0


def test_features_do_not_depend_on_company():
    texts = ["one two two", "", "A b.\nA b.\nc!", "é" * 50, None]
    together = features(pa.array(texts))
    alone = np.concatenate([features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_ranker_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    good = x[:, 1] - 0.5 * x[:, 2] > -0.3
    s = PairwiseRanker().fit(x, good).score(x)
    assert ((s >= 0.7) == good).mean() > 0.97 and F is not None


def by_hand(text):
    """The scalar features of one text, without arrays."""
    data = (text or "").encode()
    runs = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    w = [m[0] for m in runs]
    n, some = len(w), max(1, len(w))
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in w]
    lines = [[re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(rb"[^\x20\x09-\x0D]+", line)] for line in data.split(b"\n")]
    lines = [x for x in lines if x]
    ended = sum(line.split()[-1][-1:] in (b".", b"!", b"?") for line in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", line))
    size = [len(x) for x in w]
    mean = sum(size) / some
    capitals = [sum(65 <= c <= 90 for c in x) for x in w]
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    odd = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\")]-"]
    pairs = list(zip(low, low[1:]))
    return [
        math.log1p(len(data)), math.log1p(n), mean, math.sqrt(max(0, sum(s * s for s in size) / some - mean**2)),
        sum(s > 12 for s in size) / some, sum(s < 3 for s in size) / some, sum(chr(x[-1]) in odd for x in w) / some, sum(65 <= x[0] <= 90 for x in w) / some,
        sum(c == s and s > 1 for c, s in zip(capitals, size)) / some, sum(c > 1 for c in capitals) / some,
        upper / (upper + lower + 1), len(set(low)) / some, len(set(pairs)) / max(1, len(pairs)),
        len({tuple(x) for x in lines}) / max(1, len(lines)), ended / max(1, len(lines)), math.log1p(n / max(1, len(lines))), math.log1p(len(lines)),
    ]


def test_features_by_hand():
    rng = random.Random(9)
    pieces = ["word ", "Word ", "WORD", ".", "!\n", "\n", "a ", "extraordinarily ", "$$", "12 ", "é ", "\t", "b.\nb.\nb.\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 40))) for _ in range(200)] + [None, "", " ", "x" * 50_000, "line one.\n" * 3000]
    got = features(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row[:17], by_hand(t)), t
        counted = [(t or "").count(chr(c)) for c in range(33, 127) if not chr(c).isalnum()]
        assert np.allclose(row[17 : 17 + len(counted)], np.log1p(1000 * np.array(counted) / max(1, len((t or "").encode()))))


def test_scores_by_hand():
    """The score of a row, term by term, and a repeated labelled row that teaches once."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    r = PairwiseRanker().fit(x, x[:, 0] > 0)
    for row, s in zip(x[:50], r.score(x[:50]), strict=True):
        z = [min(8, max(-8, (v - m) / d)) for v, m, d in zip(row, r.mean, r.scale)]
        z = z + [max(0, v - 1) for v in z] + [max(0, -v - 1) for v in z]
        raw = sum(a * b for a, b in zip(z, r.w)) - r.threshold + math.log(0.7 / 0.3)
        assert abs(s - 1 / (1 + math.exp(-max(-60, min(60, raw))))) < 1e-9
