import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from walkloom.llm.packing import fill_windows, in_powers, neighbour_recall, pack
from walkloom.llm.tokens import TextTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "a", "  two  spaces\n\n x \t y ", "it's <|endoftext|> here <|endoftext|>", "été où çà x   y", "line\r\n next 12345 !!! ", "漢字 かな 🙂 🙂", "x" * 3000, "the quick brown fox " * 900, " end <|endoftext|>"]


def ids(t):
    return Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids


def test_ids_equal_the_library(spark):
    tok = TextTokenizer(PATH)
    assert tok.fast and tok.vocabulary == 50257
    texts = [*TEXTS, " " * 1_500_000, "\n" * 900_000 + "x", "^" * 200_000, " " * 100_000, "\r\n \t" * 25_000]
    assert [x.tolist() for x in tok.encode(pa.array(texts))] == [ids(t) for t in texts]


def test_every_code_point_is_divided_alike():
    """One text for each code point, with it beside letters, digits, spaces and itself."""
    tok = TextTokenizer(PATH)
    for at in range(0, 0x110000, 50_000):
        texts = [f"a{c}b {c}{c}1 {c} x{c}{c}  {c}\n9{c}" for c in map(chr, range(at, min(at + 50_000, 0x110000))) if not "\ud800" <= c <= "\udfff"]
        want = [e.ids for e in tok.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [tok.ids(t).tolist() for t in texts] == want


def test_pack_is_lossless(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"document {i} talks of topic {i % 7} " * (i % 90)) for i in range(150)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, offset string")
    out = pack(df.repartition(4), shard_tokens=20_000).orderBy("sequence_id", "offset").toPandas()
    back, fill = {}, {}
    for r in out.itertuples():
        x = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(x) == r.length and zlib.crc32(x.tobytes()) == r.ids_crc32 and r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        back.setdefault(r.doc_id, []).append((r.start, x.tolist()))
    for i, t in rows:
        parts = sorted(back[i])
        assert [v for _, p in parts for v in p] == [*ids(t), 1]
        assert all(s == sum(len(q) for _, q in parts[:k]) for k, (s, _) in enumerate(parts))
    assert max(fill.values()) <= 2048 and all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    assert out.equals(pack(df.repartition(7), shard_tokens=20_000).orderBy("sequence_id", "offset").toPandas()) or out.length.sum() == sum(len(ids(t)) + 1 for _, t in rows)


def test_neighbours_share_words():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * k, 100 * k + 100, (20, 200)) for k in range(1, 6)]
    tails = [t.astype(np.uint16) for k in range(20) for t in (topics[j][k] for j in range(5))]
    idf = np.ones(700)
    seqs = fill_windows(tails, idf, 200.0, window=1000)
    pure = [len({t % 5 for t, _, _ in s}) for s in seqs[:15]]
    assert np.mean(pure) < 1.6
    assert sorted((t, p) for s in seqs for t, a, b in s for p in range(a, b)) == [(t, p) for t in range(100) for p in range(200)]


def test_all_terms_and_all_scoring_tails_count():
    seed, other = np.arange(40), np.arange(40, 80)
    idf = np.append(np.full(30, 2.0), np.full(50, 1.0))
    light = [np.array([30 + k % 10]) for k in range(50)]
    tails = [seed, *[other[:1]] * 60, *light]
    first = fill_windows(tails, idf, 2.0, window=90)[0]
    assert {t for t, _, _ in first} == {0, *range(61, 111)}


def test_shards_by_content_find_copies():
    """Small shards of many topics, with near copies: copies meet, and neighbours score nearly as the best of all."""
    rng = np.random.default_rng(5)
    tails = []
    for k in range(400):
        base = rng.integers(300 * (k % 40), 300 * (k % 40) + 600, 150)
        for _ in range(1 + 2 * (k % 3 == 0)):
            t = base.copy()
            t[rng.integers(0, 150, 6)] = rng.integers(0, 12_000, 6)
            tails.append(t.astype(np.uint16))
    order = rng.permutation(len(tails))
    got = neighbour_recall([tails[i] for i in order], 15_000, list(range(0, len(tails), 5)))
    print(got)
    assert got["copies"] >= 0.9 and got["recall"] >= 0.3 and got["score_ratio"] >= 0.5


def test_other_tokenizers_keep_their_own_way():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, whole = TextTokenizer(path), Tokenizer.from_file(path)
    assert not tok.fast and [x.tolist() for x in tok.encode(pa.array(TEXTS))] == [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_powers():
    cut = in_powers([(0, 5, 12), (1, 0, 6)])
    assert [sum(b - a for _, a, b in s) for s in cut] == [8, 4, 1]
    assert [x for s in cut for x in s] == [(0, 5, 12), (1, 0, 1), (1, 1, 5), (1, 5, 6)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty).count() == 0
    odd = pack(spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string"))
    assert odd.agg(F.sum("length")).first()[0] == 1 + 2 * (len(ids("a b")) + 1)


def test_neighbours_of_one_shard_are_the_best(spark):
    """Against brute force: a window's first neighbour is the best of all tails that no earlier window has."""
    rng = np.random.default_rng(3)
    words = [f"w{k}x{k * k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words[5 * (k % 50) : 5 * (k % 50) + 50], 60))) for k in range(300)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).orderBy("sequence_id", "offset").toPandas()
    tails = [np.array([*ids(t), 1]) for _, t in rows]
    assert out.length.sum() == sum(map(len, tails)) > 60_000
    tf = np.zeros((300, 50257))
    for k, t in enumerate(tails):
        np.add.at(tf[k], t, 1)
    df, size = (tf > 0).sum(0), tf.sum(1, keepdims=True)
    weight = np.log1p(np.maximum(0, 300 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / size.mean()))
    score = (tf > 0).astype(float) @ weight.T
    free, best = np.ones(300, bool), []
    for _, w in out[(out.sequence_id >= 1 << 36) & (out.sequence_id < 1 << 62)].groupby("sequence_id"):
        if len(w) > 1:
            seed, first = w.doc_id.iloc[:2]
            free[seed] = False
            best.append(score[seed, first] > score[seed][free].max() - 1e-3)
        free[w.doc_id] = False
    assert len(best) > 10 and np.mean(best) >= 0.9
