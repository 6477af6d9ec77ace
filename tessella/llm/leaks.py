"""Test items whose passages stand in documents: an exact scan for common runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import words
from tessella.plans.materialize import materialize, once


def _starts(w: Column, n: int, step: int = 1) -> Column:
    """The places, from 1, at which runs of ``n`` words start, each ``step``-th of them."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1), F.lit(step)))


def _runs(w: Column, n: int) -> Column:
    return F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows, else to meet the other side in a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def common_runs(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n: int = 12, most_runs: int = 1_000_000) -> DataFrame:
    """(doc_id, run, items): every run of ``n`` consecutive words that a document has in common with items.

    A run of n words holds n - h + 1 runs of h = n / 2 words, so one of them starts at each (n - h + 1)-th word of the
    document: only those are looked up among all half runs of the items. Around a hit, the words that whole runs over it can
    reach are kept and compared as whole runs, word for word. Documents are read once, and only hits are shuffled. The
    items' runs are written and counted: up to ``most_runs`` they are broadcast, beyond it they are joined by a shuffle.
    """
    half = n // 2
    step = n - half + 1
    asked = items.select(F.col(item_id).alias("_item"), words(item_text).alias("_w"))
    halves = materialize(asked.select(F.explode(F.transform(_starts(F.col("_w"), half), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, half), " ")))).alias("_half")).distinct(), "halves")
    whole = materialize(asked.select("_item", F.explode(_runs(F.col("_w"), n)).alias("_run")).groupBy("_run").agg(F.collect_set("_item").alias("_items")), "runs")

    def spot(i: Column) -> Column:
        first = F.greatest(F.lit(1), i - (step - 1))
        return F.struct(
            F.xxhash64(F.array_join(F.slice("_w", i, half), " ")).alias("half"),
            F.slice("_w", first, i + n - first).alias("around"),
        )

    split = once(docs.select(doc_id, F.col(doc_text).alias("_t")), "_w", words("_t")).where(F.size("_w") >= n)
    spots = split.select(doc_id, F.explode(F.transform(_starts(F.col("_w"), half, step), spot)).alias("_s"))
    hits = spots.select(doc_id, F.col("_s.half").alias("_half"), F.col("_s.around").alias("_around")).join(_bounded(halves, most_runs), "_half", "left_semi")
    runs = hits.select(doc_id, F.explode(_runs(F.col("_around"), n)).alias("_run"))
    return runs.join(_bounded(whole, most_runs), "_run").select(doc_id, F.col("_run").alias("run"), F.col("_items").alias("items"))


def common_passages(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n: int = 12) -> DataFrame:
    """(doc_id, item_id) of every document and item with ``n`` or more consecutive words in common. Null and short texts have
    none; repeated rows count once."""
    found = common_runs(docs, doc_id, doc_text, items, item_id, item_text, n)
    return found.select(doc_id, F.explode("items").alias(item_id)).distinct()


def without_passages(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n: int = 12) -> DataFrame:
    """(doc_id, items, cleaned, removed_words) of every document with leaked passages: its items and its whole text without the
    words of any common run. ``doc_id`` must be unique; only such documents go through Python."""
    found = common_runs(docs, doc_id, doc_text, items, item_id, item_text, n)
    each = found.groupBy(doc_id).agg(F.collect_set("run").alias("_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    joined = docs.select(doc_id, F.col(doc_text).alias("_text")).join(each, doc_id)
    kinds = [joined.schema[doc_id].dataType.simpleString(), joined.schema["_items"].dataType.simpleString()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = regex.compile(r"[\p{L}\p{N}]+")
        for f in frames:
            out = []
            for key, text, runs, found_items in zip(f[doc_id], f["_text"], f["_runs"], f["_items"]):
                at = list(word.finditer(text))
                low, marked, leaked = [m.group().lower() for m in at], [False] * len(at), set(runs)
                for i in range(len(low) - n + 1):
                    if " ".join(low[i : i + n]) in leaked:
                        marked[i : i + n] = [True] * n
                kept, last = [], 0
                for i, m in enumerate(at):
                    if marked[i]:
                        start = m.start() if i == 0 or not marked[i - 1] else last
                        kept.append(text[last:start])
                        last = m.end()
                out.append((key, found_items, "".join(kept) + text[last:], sum(marked)))
            yield pd.DataFrame(out, columns=[doc_id, "items", "cleaned", "removed_words"])

    return joined.mapInPandas(run, f"{doc_id} {kinds[0]}, items {kinds[1]}, cleaned string, removed_words int")
