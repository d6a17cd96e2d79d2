"""Layouts of a locus's graph as positions; deterministic, one grouped map per locus. Pixels are no contract: the
modes keep the order along the reference and finite, spread positions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Modes by family; classic ones hold the reference on a line.
MODES = {
    "rough": "classic", "full": "classic", "layered": "classic", "straight": "classic",
    "free": "free", "radial": "free", "scatter": "free", "dag": "free",
}


def provisional_layout(axis: DataFrame) -> DataFrame:
    """(locus_id, id, x): reference nodes by running max(1, length)."""
    w = Window.partitionBy("locus_id").orderBy("idx")
    size = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    return axis.select("locus_id", "id", (F.sum(size).over(w) - size).alias("x"))


def _ranks(ids: list[str], out: dict[str, list[str]]) -> dict[str, int]:
    """Longest incoming path; a link back to a node being followed counts as none."""
    into = defaultdict(list)
    for a, bs in out.items():
        for b in bs:
            into[b].append(a)
    rank: dict[str, int] = {}
    for root in ids:
        todo, open_ = [root], set()
        while todo:
            n = todo[-1]
            if n in rank:
                todo.pop()
                continue
            wait = [m for m in into[n] if m not in rank and m not in open_ and m != n]
            if wait and n not in open_:
                open_.add(n)
                todo.extend(wait)
                continue
            open_.add(n)
            rank[n] = max((rank[m] + 1 for m in into[n] if m in rank and m != n), default=0)
            todo.pop()
    return rank


def _sweeps(ids: list[str], rank: dict[str, int], near: dict[str, list[str]], rounds: int = 8) -> dict[str, float]:
    """Barycentre ordering of layers, alternating direction."""
    layers = defaultdict(list)
    for n in ids:
        layers[rank[n]].append(n)
    y = {n: float(i) for layer in layers.values() for i, n in enumerate(layer)}
    for r in range(rounds):
        for k in sorted(layers, reverse=bool(r % 2)):
            side = [n for n in layers[k]]
            mean = {n: float(np.mean([y[m] for m in near[n] if rank[m] != k] or [y[n]])) for n in side}
            for i, n in enumerate(sorted(side, key=lambda n: (mean[n], y[n], n))):
                y[n] = float(i)
    return y


def layout(segments: DataFrame, links: DataFrame, axis: DataFrame, mode: str = "layered", rounds: int = 50, seed: int = 7) -> DataFrame:
    """(locus_id, id, x, y)."""
    if mode not in MODES:
        raise ValueError(f"unknown layout mode {mode}")
    none = F.lit(None)
    rows = segments.select("locus_id", F.col("id").alias("a"), none.cast("string").alias("b"), F.col("length").cast("double").alias("n"), F.col("seg_pos").alias("pos"))
    rows = rows.unionByName(links.select("locus_id", F.col("from_id").alias("a"), F.col("to_id").alias("b"), none.cast("double").alias("n"), F.col("link_pos").alias("pos")))
    rows = rows.join(provisional_layout(axis).select("locus_id", F.col("id").alias("a"), F.col("x").cast("double").alias("x")), ["locus_id", "a"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf.b.isna()].sort_values("pos")
        ids, fixed = nodes.a.tolist(), dict(zip(nodes.a, nodes.x, strict=True))
        known, out, near = set(ids), defaultdict(list), defaultdict(list)
        for r in pdf[pdf.b.notna()].sort_values("pos").itertuples():
            if r.a in known and r.b in known and r.a != r.b:
                out[r.a].append(r.b)
                near[r.a].append(r.b)
                near[r.b].append(r.a)
        rng = np.random.default_rng(seed)
        rank = _ranks(ids, out)
        y = _sweeps(ids, rank, near)
        pos = np.array([(rank[n] * 50.0, y[n] * 50.0) for n in ids])
        if mode == "radial":
            angle = 2 * np.pi * np.arange(len(ids)) / max(1, len(ids))
            pos = np.stack([np.cos(angle), np.sin(angle)], 1) * 20 * max(1, len(ids)) ** 0.5
        elif mode == "scatter":
            pos = rng.uniform(-1, 1, (len(ids), 2)) * 50 * max(1, len(ids)) ** 0.5
        held = np.array([MODES[mode] == "classic" and not np.isnan(fixed[n]) for n in ids])
        at = {n: i for i, n in enumerate(ids)}
        if held.any():
            pos[held] = [(fixed[n], 0.0) for n, h in zip(ids, held, strict=True) if h]
            for i, n in enumerate(ids):
                if not held[i]:
                    xs = [pos[at[m], 0] for m in near[n] if held[at[m]]]
                    pos[i] = (np.mean(xs) if xs else pos[i, 0], 30.0 * (1 + y[n]))
        edges = np.array([(at[a], at[b]) for a in out for b in out[a]], int).reshape(-1, 2)
        for _ in range(rounds if mode in ("free", "full", "radial", "scatter") and len(ids) > 1 else 0):
            move = np.zeros_like(pos)
            if len(edges):
                gap = pos[edges[:, 1]] - pos[edges[:, 0]]
                far = np.maximum(1e-6, np.hypot(*gap.T))[:, None]
                pull = gap / far * (far - 40) * 0.2
                np.add.at(move, edges[:, 0], pull)
                np.add.at(move, edges[:, 1], -pull)
            other = rng.permutation(len(ids))  # repulsion from one random other a round: linear in the nodes
            gap = pos - pos[other]
            far2 = np.maximum(25.0, (gap**2).sum(1))[:, None]
            move += gap / far2 * 200
            move[held] = 0
            pos += np.clip(move, -50, 50)
        return pd.DataFrame({"locus_id": pdf.locus_id.iloc[0], "id": ids, "x": pos[:, 0], "y": pos[:, 1]})

    return rows.groupBy("locus_id").applyInPandas(run, "locus_id string, id string, x double, y double")


def metric_ratio(nodes: DataFrame, value: str) -> DataFrame:
    """Adds `ratio` of a node metric to the locus's largest, on a log scale."""
    from walkloom.functions.sequence import log_ratio

    most = F.max(value).over(Window.partitionBy("locus_id"))
    return nodes.withColumn("ratio", log_ratio(F.col(value).cast("double"), most.cast("double")))
