"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Pairs of one accepted and one rejected document are
preferences: P(i over j) = sigmoid(w . (x_i - x_j)); w minimises the logistic loss on the feature differences (ridge
penalty, Newton steps). The threshold is a quantile of the training strengths, at the rejected share of the labels;
the score is the sigmoid of the strength, shifted so that the threshold scores `cut`.

The fit uses at most `sample_rows` labelled rows, half of them of each label where there are enough, picked by a
seeded hash, and one row of an id that repeats; of their pairs at most `pairs` preferences are drawn, with a seed.
Scoring reads every whole text. Nothing but the text enters a score.

Defined cases: null and empty texts have all-zero counts and get the score of such a text; rows that repeat an id are
each scored, and teach by the first of their texts in order; texts of any length are read whole, a task holds one batch
of them; ids must be numbers or read as such; a labelled id with two different labels, a null label or no document teaches nothing; without both
labels every document scores `cut`, and is accepted; an empty table gives an empty result; other columns pass through
`keep_good` and are not read by `quality_scores`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.llm.textkernels import mix64, slices, word_hashes, words

#: Byte classes counted per text: each ASCII sign on its own, then a-z, A-Z, digits, white space, new lines, others.
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.full(256, len(_SIGNS) + 5, np.int64)
for _i, _c in enumerate(_SIGNS):
    _CLASS[_c] = _i
_CLASS[97:123] = len(_SIGNS)
_CLASS[65:91] = len(_SIGNS) + 1
_CLASS[48:58] = len(_SIGNS) + 2
_CLASS[[9, 11, 12, 13, 32]] = len(_SIGNS) + 3
_CLASS[10] = len(_SIGNS) + 4
_CLASSES = len(_SIGNS) + 6
_UPPER, _LOWER, _DIGIT, _NEWLINE = len(_SIGNS) + 1, len(_SIGNS), len(_SIGNS) + 2, len(_SIGNS) + 4
_ENDING = np.zeros(256, bool)
_ENDING[[ord(c) for c in ".!?"]] = True
_ODD_END = np.zeros(256, bool)
_ODD_END[[c for c in _SIGNS if chr(c) not in ".,;:!?'\")]-"]] = True


def _repeats(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """How many distinct values each row has."""
    # The upper bits of the key are the row, the lower 44 a hash of the value.
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=rows)


def _block(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    size = np.diff(off)
    of = np.repeat(np.arange(rows), size)
    counts = np.bincount(of * _CLASSES + _CLASS[data], minlength=rows * _CLASSES).reshape(rows, _CLASSES)
    start, end, row = words(data, off)
    h = word_hashes(data, start, end)
    n = np.bincount(row, minlength=rows)
    length = end - start
    some = np.maximum(n, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, flag, rows) / some

    mean = np.bincount(row, length, rows) / some
    first, last = data[start] if len(start) else start, data[end - 1] if len(end) else end
    caps = np.add.reduceat(((data >= 65) & (data <= 90)).astype(np.int64), start) if len(start) else length
    pair = mix64(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    inside = row[:-1] == row[1:] if len(h) > 1 else np.zeros(0, bool)
    pairs = np.bincount(row[:-1][inside] if len(h) > 1 else row[:0], minlength=rows)
    # Lines: a hash is the sum of its words' hashes times odd numbers by place in the text's words.
    line_break = np.flatnonzero(data == 10)
    line = np.searchsorted(line_break, start, "right") + row
    l_first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(line)) - np.repeat(l_first, np.diff(np.append(l_first, len(line))))
    l_hash = np.add.reduceat(h * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), l_first) if len(l_first) else h[:0]
    l_row = row[l_first]
    lines = np.bincount(l_row, minlength=rows)
    l_last = np.append(l_first[1:], len(line)) - 1 if len(l_first) else l_first
    ended = np.bincount(l_row, _ENDING[last[l_last]] if len(l_last) else None, rows) if len(l_first) else np.zeros(rows)
    per = counts / np.maximum(size, 1)[:, None]
    letters = counts[:, _UPPER] + counts[:, _LOWER] + 1
    scalar = [
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(0, np.bincount(row, length * length, rows) / some - mean**2)),
        share(length > 12), share(length < 3), share(_ODD_END[last] if len(last) else length), share((first >= 65) & (first <= 90)), share((caps == length) & (length > 1)), share((caps > 1)),
        counts[:, _UPPER] / letters, _repeats(row, h, rows) / some, _repeats(row[:-1][inside] if len(h) > 1 else row[:0], pair[inside], rows) / np.maximum(pairs, 1),
        _repeats(l_row, l_hash, rows) / np.maximum(lines, 1), ended / np.maximum(lines, 1), np.log1p(n / np.maximum(lines, 1)), np.log1p(lines),
    ]
    return np.concatenate([np.stack(scalar, 1), np.log1p(1000 * per), np.sqrt(per[:, [_UPPER, _DIGIT, _NEWLINE]])], 1)


def features(text: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    parts = [_block(data, off) for _, data, off in slices(text)]
    return np.concatenate(parts) if parts else _block(np.zeros(0, np.uint8), np.zeros(1, np.int64))


class PairwiseRanker:
    """Strengths learned from preferences; inputs are standardised, and joined by their distances beyond knots."""

    def __init__(self, cut: float = 0.7, ridge: float = 1.0, pairs: int = 40_000, steps: int = 12, seed: int = 11):
        self.cut, self.ridge, self.pairs, self.steps, self.seed = cut, ridge, pairs, steps, seed
        self.w: np.ndarray | None = None
        self.threshold = 0.0

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.maximum(0, z - 1), np.maximum(0, -z - 1)], 1)

    def fit(self, x: np.ndarray, good: np.ndarray) -> PairwiseRanker:
        if not good.any() or good.all():
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._expand(x)
        rng = np.random.default_rng(self.seed)
        n = min(self.pairs, 50 * len(x))
        above, below = rng.choice(np.flatnonzero(good), n), rng.choice(np.flatnonzero(~good), n)
        w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            grad, curve = -self.ridge * w, (self.ridge + 1e-3) * np.eye(len(w))
            for at in range(0, n, 2000):
                d = z[above[at : at + 2000]] - z[below[at : at + 2000]]
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                grad += d.T @ (1 - p)
                curve += (d * (p * (1 - p))[:, None]).T @ d
            step = np.linalg.solve(curve, grad)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-4:
                break
        self.w = w
        self.threshold = float(np.quantile(z @ w, 1 - good.mean()))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.cut)
        raw = self._expand(x) @ self.w - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def held_out(id_col: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_ranker(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample_rows: int = 16_000, seed: int = 3, cut: float = 0.7) -> PairwiseRanker:
    known = labels.select(F.col(label_id).alias("_l_id"), F.col(label_col).alias("_good")).filter(F.col("_l_id").isNotNull() & F.col("_good").isin(0, 1) & ~held_out(F.col("_l_id")))
    known = known.groupBy("_l_id").agg(F.min("_good").alias("_good"), F.max("_good").alias("_max")).filter("_good = _max").drop("_max")
    n = {r["_good"]: r["count"] for r in known.groupBy("_good").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("_l_id")), F.lit(1_000_003)) / 1_000_003
    share = F.when(F.col("_good") == 1, min(1.0, sample_rows / 2 / max(1, n.get(1, 0)))).otherwise(min(1.0, sample_rows / 2 / max(1, n.get(0, 0))))
    picked = known.filter(draw < share)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    taught = text.join(F.broadcast(picked), F.col("_id") == F.col("_l_id"))
    taught = taught.groupBy(F.col("_id").cast("long").alias("_id"), F.col("_good").cast("int").alias("good")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("_id", "text", "good")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1)).astype(np.float32)
            yield pa.record_batch([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "good", "x"])

    pdf = taught.mapInArrow(measure, "id long, good int, x binary").toPandas().sort_values(["id", "x"], ignore_index=True)
    ranker = PairwiseRanker(cut=cut)
    if not len(pdf):
        return ranker
    # Labels as they are in the corpus, not as sampled, set the quantile.
    x = np.frombuffer(b"".join(pdf.x), np.float32).reshape(len(pdf), -1).astype(float)
    good = pdf.good.to_numpy() == 1
    ranker.fit(x, good)
    if ranker.w is not None:
        raw = ranker._expand(x) @ ranker.w
        weight = np.where(good, n.get(1, 0) / max(1, good.sum()), n.get(0, 0) / max(1, (~good).sum()))
        order = np.argsort(raw)
        at = np.searchsorted(np.cumsum(weight[order]), weight[~good].sum() * (1 - 1e-9)) + 1  # so many are rejected
        low, high = raw[order[at - 1]], raw[order[min(at, len(raw) - 1)]]
        ranker.threshold = float((low + high) / 2)
    return ranker


def scorer(ranker: PairwiseRanker):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(ranker.score(features(text).astype(np.float32).astype(float)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7, **how) -> DataFrame:
    """(id, held_out, score, accepted) of every row."""
    ranker = fit_ranker(docs, labels, id_col, text_col, cut=cut, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = ranker.score(features(b.column(1)).astype(np.float32).astype(float))
            yield pa.record_batch([b.column(0), pa.array(s)], names=["id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= cut).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7, **how) -> DataFrame:
    """The rows of docs that score at least cut, with all their columns."""
    score = scorer(fit_ranker(docs, labels, id_col, text_col, cut=cut, **how))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return whole.filter(score("_text") >= cut).select("_row.*")
