"""Weighted similarity of feature vectors: scores, blocking, threshold, best match, one-to-one choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import light
from .warping import best_scores

#: Rows that a block of the right side holds, and left rows that are scored against one at once.
BLOCK_ROWS, AT_ONCE = 4096, 256
#: Weights of the parts of a score.
WEIGHTS = {"tempo": 0.25, "loudness": 0.25, "dtw": 2.5, "euclid": 1.0, "cosine": 0.25}


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each of b; the small term keeps zero vectors at 0."""
    return a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1) + 1e-8)


def closeness(distance: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + distance)


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance of two sequences of frames, divided by their joint length."""
    cost = np.linalg.norm(a[:, None] - b[None], axis=2)
    best = np.full(len(b) + 1, np.inf)
    best[0] = 0
    for row in cost:
        now = np.full(len(b) + 1, np.inf)
        low = np.minimum(best[:-1], best[1:])
        for j, c in enumerate(row):
            now[j + 1] = c + min(low[j], now[j])
        best = now
    return float(best[-1] / (len(a) + len(b)))


def weighted(parts: dict, weights: dict[str, float] = WEIGHTS):
    """The parts' mean by weight; numbers or arrays."""
    whole = sum(weights[k] for k in parts)
    return sum(weights[k] * v for k, v in parts.items()) / whole if whole else 0.0


def best_matches(left: DataFrame, right: DataFrame, id_col: str, vector: str, block: str, exclude_self: bool = True) -> DataFrame:
    """For each left row the right row of its block with the highest cosine: id, match_id, score (6 digits). Ties: the least id."""

    def score(l: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
        return cosine(np.stack(l.v.to_numpy()).astype(float), np.stack(r.v.to_numpy()).astype(float))

    return _best(left, right, id_col, block, {"v": vector}, score, exclude_self)


def weighted_matches(left: DataFrame, right: DataFrame, id_col: str, block: str, vector: str | None = None, tempo: str | None = None, loudness: str | None = None, seconds: str | None = None, frames: str | None = None, tempo_apart: float | None = None, seconds_apart: float | None = None, band: int | None = None, weights: dict[str, float] = WEIGHTS, exclude_self: bool = False) -> DataFrame:
    """For each left row the right row of its block with the highest weighted score: id, match_id, score (6 digits). Ties: the least id.

    The parts of the score are those whose columns are given: closeness of
    tempo and of loudness, closeness by warping of `frames` (arrays of
    vectors), by distance of `vector`, and its cosine; each with its weight,
    over the weights of the parts. Pairs whose tempo is more than tempo_apart
    away, or whose durations differ by more than seconds_apart of the longer,
    are none. Of the others only those are warped whose bound may beat what is
    known (see warping), within `band` frames of the diagonal if one is given.
    """
    columns = {k: c for k, c in (("v", vector), ("tempo", tempo), ("loudness", loudness), ("seconds", seconds), ("frames", frames)) if c}

    def score(l: pd.DataFrame, r: pd.DataFrame) -> np.ndarray:
        apart = lambda c: np.abs(l[c].to_numpy(float)[:, None] - r[c].to_numpy(float))
        near = np.ones((len(l), len(r)), bool)
        if tempo and tempo_apart is not None:
            near &= apart("tempo") <= tempo_apart
        if seconds and seconds_apart is not None:
            near &= apart("seconds") <= seconds_apart * np.maximum(l.seconds.to_numpy(float)[:, None], r.seconds.to_numpy(float))
        parts = {c: closeness(apart(c)) for c in ("tempo", "loudness") if c in columns}
        if vector:
            a, b = np.stack(l.v.to_numpy()).astype(float), np.stack(r.v.to_numpy()).astype(float)
            square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
            parts |= {"euclid": closeness(np.sqrt(np.maximum(square, 0))), "cosine": cosine(a, b)}
        if frames:
            if exclude_self:
                near &= l.id.to_numpy()[:, None] != r.id.to_numpy()
            rest = sum((weights[k] * v for k, v in parts.items()), np.zeros(near.shape))
            return best_scores(list(l.frames), list(r.frames), near, rest, weights["dtw"], weights["dtw"] + sum(weights[k] for k in parts), band)[0]
        return np.where(near, weighted(parts, weights), -np.inf)

    def ready(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(frames=[np.stack(x).astype(float) for x in rows.frames]) if frames else rows

    return _best(left, right, id_col, block, columns, score, exclude_self, ready)


def _best(left: DataFrame, right: DataFrame, id_col: str, block: str, columns: dict[str, str], score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], exclude_self: bool, ready: Callable[[pd.DataFrame], pd.DataFrame] = lambda rows: rows) -> DataFrame:
    """For each left row the best of its block: each block is cut into pieces of BLOCK_ROWS on both sides, pieces meet in pairs, and the best of each pair of pieces meet in a grouped maximum. No task holds more than a piece of either side; the number of pairs is a block's own rows squared, so blocks are the caller's way to keep it small. ready: what a task does to a piece before it is scored."""
    cut = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_ROWS)).cast("int")
    sizes = left.groupBy(F.col(block).alias("b")).agg(F.count("*").alias("m")).join(right.groupBy(F.col(block).alias("b")).agg(F.count("*").alias("n")), "b")
    sized = light(sizes)
    side = lambda df: df.select(F.col(id_col).alias("id"), F.col(block).alias("b"), *[F.col(c).alias(k) for k, c in columns.items()]).join(sized, "b")
    own, every = (lambda n: F.pmod(F.xxhash64("id"), cut(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), cut(n) - 1)))
    rows_l = side(left).withColumn("i", own("m")).withColumn("j", every("n")).withColumn("left", F.lit(True))
    rows_r = side(right).withColumn("i", every("m")).withColumn("j", own("n")).withColumn("left", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = pdf[pdf.left], pdf[~pdf.left].sort_values("id")
        if not len(l) or not len(r):
            return pd.DataFrame({"id": [], "match_id": [], "score": []})
        l, r = ready(l), ready(r)
        return pd.concat([some(l[k : k + AT_ONCE], r) for k in range(0, len(l), AT_ONCE)])

    def some(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        s = np.round(score(l, r), 6)
        if exclude_self:
            s[l.id.to_numpy()[:, None] == r.id.to_numpy()] = -np.inf
        at = s.argmax(axis=1)
        best = s[np.arange(len(l)), at]
        ok = np.isfinite(best)
        return pd.DataFrame({"id": l.id.to_numpy()[ok], "match_id": r.id.to_numpy()[at[ok]], "score": best[ok]})

    found = rows_l.unionByName(rows_r).groupBy("b", "i", "j").applyInPandas(run, "id long, match_id long, score double")
    top = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("match_id")).alias("m"))).alias("t"))
    return top.select(F.col("id").alias(id_col), (-F.col("t.m")).alias("match_id"), F.col("t.score").alias("score"))


def one_to_one(pairs: DataFrame, problem: str, left: str, right: str, score: str) -> DataFrame:
    """Greedy choice in each problem: pairs by falling score (then left, right), each side used once.

    Inherently sequential, so a problem is one task; problems are independent.
    """
    schema = f"{problem} {pairs.schema[problem].dataType.simpleString()}, {left} {pairs.schema[left].dataType.simpleString()}, {right} {pairs.schema[right].dataType.simpleString()}, {score} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        for i, l, r in pdf.sort_values([score, left, right], ascending=[False, True, True])[[left, right]].itertuples():
            if l not in used_l and r not in used_r:
                used_l.add(l)
                used_r.add(r)
                keep.append(i)
        return pdf.loc[keep, [problem, left, right, score]]

    return pairs.groupBy(problem).applyInPandas(run, schema)


def unmatched(left: DataFrame, right: DataFrame, matches: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """(side, id) of rows on either side that no match names."""
    l = left.select(left_id).join(matches.select(left_id).distinct(), left_id, "left_anti").select(F.lit("left").alias("side"), F.col(left_id).alias("id"))
    r = right.select(right_id).join(matches.select(right_id).distinct(), right_id, "left_anti").select(F.lit("right").alias("side"), F.col(right_id).alias("id"))
    return l.unionByName(r)


def needle_hits(docs: DataFrame, needles: DataFrame, id_col: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """(id, needle_id): documents that hold a needle's text, in one pass by an Aho-Corasick automaton.

    The needles are a search list; the automaton is sent to the tasks after a
    check of its size (64 MB of text), longer lists go in several passes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    held: list[tuple[int, str]] = []
    size, parts = 0, []

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, by_text = ahocorasick.Automaton(), {}
            for i, t in shared.value:
                by_text.setdefault(t, []).append(i)
            for t, ids in by_text.items():
                automaton.add_word(t, ids)
            automaton.make_automaton()
            for b in batches:
                ids, found = [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    hit = {i for _, x in automaton.iter(t or "") for i in x}
                    ids += [d] * len(hit)
                    found += sorted(hit)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=[id_col, needle_id])

        return rows.mapInArrow(run, f"{id_col} long, {needle_id} long")

    for r in needles.filter(F.length(needle) > 0).select(F.col(needle_id).cast("long"), needle).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= 64 << 20:
            parts.append(scan(held))
            held, size = [], 0
    if held or not parts:
        parts.append(scan(held) if held else docs.sparkSession.createDataFrame([], f"{id_col} long, {needle_id} long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
