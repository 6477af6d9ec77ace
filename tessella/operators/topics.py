"""Topics of texts: non-negative factorisation of TF-IDF rows by multiplicative updates, and tables about the topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import discard, materialize

FLOOR = 1e-8


def term_rows(weights: DataFrame, id_col: str) -> DataFrame:
    """(id, places, weights): one sparse row for each document, places counting from 0."""
    pairs = F.array_sort(F.collect_list(F.struct((F.col("place") - 1).alias("p"), F.col("weight").alias("w"))))
    return weights.groupBy(F.col(id_col).alias("id")).agg(pairs.alias("x")).select("id", F.col("x.p").alias("places"), F.col("x.w").alias("weights"))


def start_weights(k: int, seed: int):
    """Uniform starting weights from the md5 of seed, id and topic, so that they don't depend on partitions."""
    part = lambda t: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(t)))), 1, 8), 16, 10).cast("double") / 2.0**32
    return F.array(*[part(t) + 1e-4 for t in range(k)])


def update_w(x: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return w * (x @ h.T) / np.maximum(w @ (h @ h.T), FLOOR)


def update_h(h: np.ndarray, wx: np.ndarray, ww: np.ndarray) -> np.ndarray:
    return h * wx / np.maximum(ww @ h, FLOOR)


def _dense(batch: pa.RecordBatch, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and their topic weights of one batch; a batch holds 10,000 rows at most, and terms are bounded."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    x = np.zeros((batch.num_rows, terms))
    x[np.repeat(np.arange(batch.num_rows), sizes), batch.column(1).flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
    return x, batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)


def factorise(rows: DataFrame, terms: int, k: int = 8, seed: int = 42, rounds: int = 40, block: int = 10, tolerance: float = 1e-5) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(id, w) of every row, the k x terms matrix and the reconstruction error after each round.

    A round updates the matrix from the sums WX and WW of all rows and then each row's weights, so only k x (terms + k)
    numbers, summed over rows on the executors, leave them. Weights are written every ``block`` rounds; in between, a row's
    updates are made anew from the written ones, so nothing but the rows is read. Ends after ``rounds`` rounds or when the error
    falls by less than ``tolerance`` of itself; the error never grows. No rows give no weights and the starting matrix.
    """
    rng = np.random.default_rng(seed)
    h = rng.random((k, terms)) + 1e-4
    now = materialize(rows.withColumn("w", start_weights(k, seed)), "weights")
    path: list[np.ndarray] = []
    errors: list[float] = []

    def advance(batches: Iterator[pa.RecordBatch], steps: list[np.ndarray]):
        for b in batches:
            x, w = _dense(b, terms)
            for m in steps:
                w = update_w(x, w, m)
            yield b, x, w

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * terms + k * k + 1)
            for _, x, w in advance(batches, steps):
                total += np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel(), [(x * x).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        out = np.zeros(k * terms + k * k + 1)
        for r in now.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def written(steps: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, _, w in advance(batches, steps):
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), cells], ["id", "places", "weights", "w"])

        return materialize(now.mapInArrow(run, now.schema), "weights")

    for n in range(rounds):
        s = sums(path)
        wx, ww, xx = s[: k * terms].reshape(k, terms), s[k * terms : -1].reshape(k, k), s[-1]
        if path:
            errors.append(float(np.sqrt(max(0.0, xx - 2 * (h * wx).sum() + (ww * (h @ h.T)).sum()))))
            if len(errors) > 1 and errors[-2] - errors[-1] <= tolerance * errors[-2]:
                break
        if len(path) >= block:
            old, now = now, written(path)
            discard(old)
            path = []
        h = update_h(h, wx, ww)
        path.append(h)
    return written(path).select("id", "w"), h, errors


def topic_terms(h: np.ndarray, vocab: DataFrame, rows: int, top: int = 12) -> DataFrame:
    """(topic, rank, term, loading, df, coverage_pct, cf) of the strongest terms of each topic; ties by place."""
    spark = vocab.sparkSession
    cells = [(t + 1, int(p) + 1, float(h[t, p])) for t in range(h.shape[0]) for p in range(h.shape[1])]
    loads = spark.createDataFrame(cells, "topic int, place int, loading double").join(F.broadcast(vocab), "place")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("loading"), "place"))
    return loads.withColumn("rank", place).where(F.col("rank") <= top).select("topic", "rank", "term", "loading", "df", (F.col("df") * 100.0 / max(rows, 1)).alias("coverage_pct"), "cf")


def topic_summary(df: DataFrame, topic: str, weights: list[str], text: str, id_col: str, kinds: list[str]) -> DataFrame:
    """For each dominant topic: rows, share, their mean weight of it, the most frequent value of each of ``kinds`` (ties to
    the least) and the text of the row with the largest weight (ties to the least id)."""
    w = F.get(F.array(*[F.col(c) for c in weights]), F.col(topic) - 1)
    rows = df.where(F.col(topic).isNotNull()).withColumn("_w", w)
    base = rows.groupBy(topic).agg(F.count(F.lit(1)).alias("rows"), F.avg("_w").alias("mean_weight"), F.max_by(text, F.struct("_w", -F.col(id_col))).alias("excerpt"))
    base = base.withColumn("share_pct", F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy()))
    for c in kinds:
        counted = rows.where(F.col(c).isNotNull()).groupBy(topic, c).agg(F.count(F.lit(1)).alias("n"))
        base = base.join(counted.groupBy(topic).agg(F.min_by(c, F.struct(-F.col("n"), c)).alias(f"dominant_{c}")), topic, "left")
    return base
