import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from walkloom.llm.exact_dedup import drop_copies, exact_groups
from walkloom.llm.near_dup import drop_near_copies, least_matches, near_duplicates

KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b"), (2, "ab"), (3, "a\tb "), (None, "a b"), (5, None), (6, ""), (7, " \n"), (8, "x"), (8, "x"), (9, " x")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[squeeze(t)].append((i, len(t or "")))
    out, done = [], set()
    for i, t in rows:
        g = by[squeeze(t)]
        keep, cp = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        kept = i == keep and len(t or "") == cp and squeeze(t) not in done
        done |= {squeeze(t)} if kept else set()
        out.append((i, keep, len(g), kept, hashlib.sha256(squeeze(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ODD, [], [(i, "hot  text" if i % 3 else f"t {i % 50}") for i in range(3000)]])
def test_exact_groups(spark, rows):
    df = docs(spark, rows).withColumn("kept", F.lit(1)).withColumn("digest", F.lit("clash"))
    got = exact_groups(df.repartition(5)).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "ab "), (2, "ab"), (None, "z"), (None, "z")]
    got = exact_groups(docs(spark, rows)).filter("kept").collect()
    assert sorted((r.id or 0, r.group_size) for r in got) == [(0, 2), (1, 4)]


def test_shared_digests_are_told_apart(spark):
    """With a digest of one character contents share digests; the groups are the same."""
    rows = [(i, f"text {i % 37}" + " " * (i % 3)) for i in range(400)] + ODD
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    got = exact_groups(docs(spark, rows).repartition(3), digest=weak).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:4] for r in brute_groups(rows)), key=str)
    left = drop_copies(docs(spark, rows), digest=weak).collect()
    assert len(left) == len({squeeze(t) for _, t in rows}) == len({squeeze(r.text) for r in left})


def test_drop_copies_of_rows_with_maps_and_long_texts(spark):
    df = docs(spark, [(1, "ab" * 300_000), (1, "ab" * 300_000), (2, "x")]).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    assert sorted(r.doc_id for r in drop_copies(df).collect()) == [1, 2]


def test_drop_copies(spark):
    df = docs(spark, ODD).withColumn("_row", F.lit(3))
    got = drop_copies(df)
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len({squeeze(t) for _, t in ODD}) == len({squeeze(t) for _, t in rows})
    assert (3, "a\tb ") in rows and drop_copies(docs(spark, [])).count() == 0


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a2, b2 = find(a), find(b)
                up[max(a2, b2)] = min(a2, b2)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed=3):
    """A large group of near copies of all degrees, a long passage shared by many, and lone texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, passage, rows = [word() for _ in range(90)], [word() for _ in range(60)], []
    for _ in range(120):
        w, edits = list(base), rng.choice([1, 2, 4, 6, 8, 9, 10, 11, 12, 14])
        for _ in range(edits):
            j = rng.randrange(len(w))
            w[j : j + 1] = rng.choice([[word()], [], [w[j], word()]])
        rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(60)]
    rows += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(40)] + rows[:5] + ["", " ", None, "one", "ONE", "one two", "two one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rows = family()
    got = near_duplicates(docs(spark, rows), k=k).collect()
    want = brute_near(rows, k)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A  b\nc"), (None, "a b c"), (None, "z z z"), (4, None), (5, "")]
    got = near_duplicates(docs(spark, rows).withColumn("component_id", F.lit(9)), k=2).collect()
    assert len(got) == 7
    assert {(r.id, r.n_shingles, r.component_id) for r in got} == {(1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (4, 0, 4), (5, 0, 5)}
    assert near_duplicates(docs(spark, [])).count() == 0
    kept = drop_near_copies(docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_near_repeated_ids(spark):
    """One id with two texts, rows without ids, and whole rows repeated: each row follows its own text."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(3)]
    near = [t.rsplit(" ", 1)[0] + " end" for t in texts]
    rows = [(7, texts[0]), (7, texts[1]), (9, near[1]), (None, texts[2]), (None, near[2]), (4, near[0]), (4, near[0])]
    got = near_duplicates(docs(spark, rows), k=2).collect()
    assert sorted((r.id, r.component_id) for r in got if r.id) == [(4, 4), (4, 4), (7, 4), (7, 7), (9, 7)]
    assert [r.component_id for r in got if r.id is None] == [None, None]
    kept = drop_near_copies(docs(spark, rows), k=2)
    assert len(kept.collect()) == 3 and kept.columns == docs(spark, []).columns
    assert drop_near_copies(docs(spark, [(1, None), (1, None), (2, " ")])).count() == 3


def test_near_recall_of_adversarial_groups(spark):
    """Copies just above and just below the threshold around one centre, with a passage that many share: no link of
    the brute-force version is lost."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, shared = [word() for _ in range(140)], [word() for _ in range(14)]
    rows = []
    for n in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((n, " ".join(w + (shared if n % 3 else []))))
    got = {r.id: r.component_id for r in near_duplicates(docs(spark, rows), k=2).collect()}
    want = {i: c for i, (_, c) in brute_near(rows, 2).items()}
    linked = [i for i in want if want[i] != i]
    print("recall of links:", sum(got[i] == want[i] for i in linked) / len(linked), "of", len(linked))
    assert got == want


def test_bayes_bound_is_monotone():
    bounds = [least_matches(n, 0.8, 1e-6) for n in range(16, 129, 16)]
    assert bounds == sorted(bounds) and bounds[-1] < 0.8 * 128
