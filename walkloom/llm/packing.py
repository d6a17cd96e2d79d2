"""Packing by lexical retrieval.

1. Every text is tokenised once and closed by `end_id`. Whole windows of a long document are sequences of their
   own; its last, shorter part (its tail) is packed with others. Each tail is one document of the index.
2. In how many tails each token id occurs is counted over all of them, a table no larger than the vocabulary: these
   counts weigh BM25 in every shard alike.
3. Tails are dealt to shards of the inverted index by content. A tail's key is a row of weighted min-hashes of its
   terms (in each, the term that wins a race run at the speed of its idf): two tails agree in each with the
   probability of their weighted Jaccard similarity, so copies and texts that share rare terms stand together. The
   tails are range-partitioned in order of their keys, and every `shard_tokens` tokens in that order are a shard:
   however many tails share a key, or are copies, a shard is bounded, and stays a run of the most alike.
4. In a shard, seeds go in order; each gets its BM25 neighbours among the unused tails by all of its terms, fetched
   until none scores, and they fill its window, the last cut to fit. What is left of a cut tail is the next seed; what
   has not filled a window at the end of a shard goes on in the next of that task. A task's last sequence is cut into
   powers of two, which need no padding.

The work grows with the tails: a seed is compared with a shard, not with the table. What this loses of an exhaustive
search is measured by `neighbour_recall` and stated in the README.

Defined cases: null and empty texts are the one id `end_id`; repeated rows and null ids are packed like any others;
ids must be numbers or read as such; a text of any length is tokenised whole, a task holds one batch of texts and one
shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.tokens import default_tokenizer, shared_tokenizer, vocabulary_size
from walkloom.sharedfs import materialize

_PARTS = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("ids", pa.binary())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECE_KINDS = [pa.int64()] * 7 + [pa.binary()]
_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_K1, _B = 1.2, 0.75
_KEYS = 4  # min-hashes in a tail's key


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def _tokenise(path: str, end_id: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = shared_tokenizer(path)
        kind_of = np.uint16 if tok.vocabulary <= 1 << 16 else np.uint32
        seen = np.zeros(max(tok.vocabulary, end_id + 1), np.int64)
        sequence = (1 << 62) + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for d, ids in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1)), strict=True):
                x = np.append(ids, np.uint32(end_id))
                whole = len(x) // window * window
                for s in range(0, whole, window):
                    part = x[s : s + window]
                    out.append(("whole", d, s, window, checksum(part), len(x), sequence, part.astype(kind_of).tobytes() if with_ids else None))
                    sequence += 1
                if whole < len(x):
                    seen[np.unique(x[whole:])] += 1
                    out.append(("tail", d, whole, len(x) - whole, checksum(x[whole:]), len(x), None, x[whole:].astype(kind_of).tobytes()))
                held += len(x)
                if held >= 1 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARTS, strict=True)], schema=_PARTS)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PARTS, strict=True)], schema=_PARTS)
        terms = np.flatnonzero(seen)
        if len(terms):
            none = pa.nulls(len(terms))
            yield pa.record_batch([pa.array(["seen"] * len(terms)), none.cast(pa.int64()), pa.array(terms, pa.int64()), pa.array(seen[terms], pa.int64()), *[none.cast(pa.int64())] * 3, none.cast(pa.binary())], schema=_PARTS)

    return run


def races(idf: np.ndarray, seed: int = 17) -> np.ndarray:
    """One row of finishing times a min-hash: exponential, at the speed of each term's idf."""
    return np.random.default_rng(seed).exponential(size=(_KEYS, len(idf))) / np.maximum(idf, 1e-9)


def content_keys(tails: list[np.ndarray], times: np.ndarray) -> list[np.ndarray]:
    """The winning term of each race, for each tail; none may be empty."""
    flat = np.concatenate(tails)
    first = np.cumsum([0, *map(len, tails[:-1])])
    out = []
    for t in times:
        order = np.empty(len(t), np.int64)
        place = np.argsort(t, kind="stable")
        order[place] = np.arange(len(t))
        out.append(place[np.minimum.reduceat(order[flat], first)])
    return out


def _keyed(idf: np.ndarray, wide: str):
    names = ["doc_id", "start", "ids_crc32", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = races(idf)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = content_keys([np.frombuffer(b, wide) for b in part.column("ids").to_pylist()], times)
                yield pa.record_batch([part.column(c) for c in names] + [pa.array(k, pa.int64()) for k in keys], names=[*names, *[f"k{i}" for i in range(_KEYS)]])

    return run, "doc_id long, start long, ids_crc32 long, doc_tokens long, ids binary, " + ", ".join(f"k{i} long" for i in range(_KEYS))


class ShardIndex:
    """BM25 weights of some tails, by term: rows over all tails for the terms that many have, postings for the others.
    Weights come from corpus-wide document frequencies."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = _K1, b: float = _B):
        size, n = np.array([len(t) for t in tails]), len(tails)
        key = np.sort((np.repeat(np.arange(n, dtype=np.int64), size) << 32) | np.concatenate(tails).astype(np.int64))
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(cut, len(key)))
        key = key[cut]
        doc, term = key >> 32, key & 0xFFFFFFFF
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / mean))
        self.of, self.n = np.searchsorted(doc, np.arange(n + 1)), n
        # Terms are numbered anew, those of many tails first.
        held, term = np.unique(term, return_inverse=True)
        df = np.bincount(term, minlength=len(held))
        place = np.argsort(-df, kind="stable")
        number = np.empty(len(held), np.int64)
        number[place] = np.arange(len(held))
        self.term, self.common = number[term], int((df > max(1, n / 32)).sum())
        often = self.term < self.common
        self.rows = np.zeros((self.common, n), np.float32)
        self.rows[self.term[often], doc[often]] = weight[often]
        order = np.argsort(self.term[~often], kind="stable")
        self.doc, self.weight = doc[~often][order], weight[~often][order]
        self.first = np.searchsorted(self.term[~often][order], np.arange(len(held) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of all tails, by all of the seed's terms."""
        t = self.term[self.of[seed] : self.of[seed + 1]]
        score = self.rows[t[t < self.common]].sum(0, dtype=np.float64)
        rare = t[t >= self.common]
        run = self.first[rare + 1] - self.first[rare]
        at = np.repeat(self.first[rare] - np.cumsum(run) + run, run) + np.arange(run.sum())
        np.add.at(score, self.doc[at], self.weight[at])
        return score

    def neighbours(self, seed: int, free: np.ndarray, most: int) -> list[int]:
        """Free tails that share any of the seed's terms, best first; ties by place."""
        score = self.scores(seed)
        score[~free] = 0
        best = np.argpartition(-score, most)[:most] if self.n > most else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


def fill_windows(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = 2048, most: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (tail, from, to), the last as long as its tails allow; most: neighbours fetched at once."""
    index = ShardIndex(tails, idf, mean)
    free = np.ones(len(tails), bool)
    out: list[list[tuple[int, int, int]]] = []
    rest: tuple[int, int] | None = None
    upto = 0  # all tails before it are used

    def unused() -> int | None:
        nonlocal upto
        while upto < len(tails) and not free[upto]:
            upto += 1
        return upto if upto < len(tails) else None

    while rest or unused() is not None:
        seed, start = rest or (unused(), 0)
        free[seed] = False
        seq, room = [(seed, start, len(tails[seed]))], window - (len(tails[seed]) - start)
        rest = None
        queue, more = [], True
        while room:
            if not queue and more:
                queue = index.neighbours(seed, free, most)
                more = len(queue) == most
            t = queue.pop(0) if queue else unused()
            if t is None:
                break
            free[t] = False
            n = min(room, len(tails[t]))
            seq.append((t, 0, n))
            room -= n
            if n < len(tails[t]):
                rest = (t, n)
        out.append(seq)
    return out


def in_powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """One sequence cut into sequences whose lengths are its powers of two, largest first."""
    left, out = list(seq), []
    total = sum(b - a for _, a, b in seq)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, part = total & (1 << bit), []
        while room:
            t, a, b = left.pop(0)
            n = min(room, b - a)
            part.append((t, a, a + n))
            if a + n < b:
                left.insert(0, (t, a + n, b))
            room -= n
        if part:
            out.append(part)
    return out


def neighbour_recall(tails: list[np.ndarray], shard_tokens: int, queries: list[int], most: int = 10) -> dict[str, float]:
    """How the neighbours that a tail's shard offers compare with those of a brute-force search of all tails: the share
    of the best `most` that are there, the ratio of the sums of their scores, and the share of the nearest copies
    (tails that score at least nine tenths of what the tail itself scores) that are there."""
    size = np.array([len(t) for t in tails])
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]).astype(np.int64))
    idf = np.log1p((len(tails) - df + 0.5) / (df + 0.5))
    order = np.lexsort(content_keys(tails, races(idf))[::-1])
    shard = np.empty(len(tails), np.int64)
    shard[order] = np.cumsum(size[order]) // shard_tokens
    index, met, ratio, copies = ShardIndex(tails, idf, size.mean()), [], [], []
    for q in queries:
        score = index.scores(q)
        own, score[q] = score[q], 0
        best = np.argsort(-score, kind="stable")[:most]
        pool = np.flatnonzero((shard == shard[q]) & (np.arange(len(tails)) != q))
        here = pool[np.argsort(-score[pool], kind="stable")[:most]]
        met.append(np.isin(best, here).mean())
        ratio.append(score[here].sum() / score[best].sum())
        if score[best[0]] >= 0.9 * own:
            copies.append(score[here[0]] >= 0.9 * own if len(here) else False)
    return {"recall": float(np.mean(met)), "score_ratio": float(np.mean(ratio)), "copies": float(np.mean(copies)) if copies else 1.0}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, window: int = 2048, shard_tokens: int = 2_000_000, with_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids); ids are
    little-endian numbers of 16 bits (32 where the vocabulary needs them), or null unless with_ids."""
    path = tokenizer or default_tokenizer()
    wide = "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(_tokenise(path, end_id, window, with_ids), "kind string, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary")
    parts = materialize(parts, "pack-parts", ["kind"])
    tails = parts.filter("kind = 'tail'")
    seen = parts.filter("kind = 'seen'").groupBy("start").agg(F.sum("length").alias("n")).collect()  # at most one row a token id
    total = tails.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    n_tails, mean = total["n"], max(1.0, (total["tokens"] or 0) / max(1, total["n"]))
    idf = np.zeros(max([r["start"] for r in seen], default=0) + 1)
    for r in seen:
        idf[r["start"]] = np.log1p(max(0.0, n_tails - r["n"] + 0.5) / (r["n"] + 0.5))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = (TaskContext.get().partitionId() + 1) << 36
        held: list[tuple] = []  # (doc_id, where its ids begin, doc_tokens, ids) of unpacked tails
        tokens = 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held, tokens
            ids = [h[3] for h in held]
            sequences = fill_windows(ids, idf, mean, window)
            left: list[tuple] = []
            if sequences and sum(b - a for _, a, b in sequences[-1]) < window:
                if last:
                    sequences[-1:] = in_powers(sequences[-1])
                else:
                    left = [(held[t][0], held[t][1] + a, held[t][2], ids[t][a:b]) for t, a, b in sequences.pop()]
            out = []
            for seq in sequences:
                offset = 0
                for t, a, b in seq:
                    x = ids[t][a:b]
                    out.append((held[t][0], held[t][1] + a, b - a, checksum(x), held[t][2], sequence, offset, x.tobytes() if with_ids else None))
                    offset += b - a
                sequence += 1
            held, tokens = left, sum(len(x[3]) for x in left)
            cols = zip(*out, strict=True) if out else [[]] * len(_PIECE_KINDS)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, _PIECE_KINDS, strict=True)], names=_PIECE_NAMES)

        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")}
            for d, s, n, b in zip(*col.values(), strict=True):
                held.append((d, s, n, np.frombuffer(b, wide)))
                tokens += len(held[-1][3])
                if tokens >= shard_tokens:
                    yield packed(False)
        if held:
            yield packed(True)

    run, kinds = _keyed(idf, wide)
    order = [*[f"k{i}" for i in range(_KEYS)], "ids_crc32", "doc_id", "start"]
    keyed = tails.select("doc_id", "start", "ids_crc32", "doc_tokens", "ids").mapInArrow(run, kinds)
    tasks = max(1, -(-(total["tokens"] or 0) // (2 * shard_tokens)))
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "start", "doc_tokens", "ids")
    whole = parts.filter("kind = 'whole'").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "ids")
    return dealt.mapInArrow(shards, _PIECES).unionByName(whole)
