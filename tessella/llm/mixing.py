"""Mixing sources to target weights: token counts, hash-random order, distributed prefix sums and a cut at each budget."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize
from tessella.plans.skew import join_to_unique

#: The vocabulary counted in by default, by its name among the public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, source: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every document, whole texts, in the byte-level vocabulary file at ``vocabulary``.

    A null text has no tokens; documents without a source are left out, as no target can name them.
    """
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    slim = docs.where(F.col(source).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return slim.mapInArrow(count, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, source string, tokens long")


def prefix_sums(counted: DataFrame, totals: DataFrame, seed: int, rows_a_range: int) -> DataFrame:
    """``counted`` with ``upto``: the tokens of its source's documents up to and with each one, in a hash-random order.

    Each source is cut into ranges of the hash with about ``rows_a_range`` documents each, so a source with a third of all
    documents is sorted in many tasks; a range starts where the sums of the ranges before it end. Equal hashes go by id.
    """
    key = F.xxhash64(F.lit(seed), "doc_id")
    placed = join_to_unique(counted.withColumn("_key", key), totals.select("source", "documents", F.greatest(F.lit(1), F.ceil(F.col("documents") / rows_a_range)).alias("_ranges")), ["source"], "documents")
    place = F.least(F.floor((F.col("_key") / F.lit(2.0**64) + 0.5) * F.col("_ranges")), F.col("_ranges") - 1)
    placed = placed.withColumn("_range", place).drop("_ranges")
    ranges = placed.groupBy("source", "_range").agg(F.sum("tokens").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("source", "_range", before.alias("_before"))
    within = F.sum("tokens").over(Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_within", within).join(starts, ["source", "_range"]).withColumn("upto", F.col("_within") + F.col("_before")).drop("_key", "_range", "_within", "_before")


def budgets(targets: DataFrame, totals: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Each row of ``targets`` (mix_name, source, target_share, max_repeats) with what the source has and its budget.

    Sources without documents or tokens can give nothing: their share is spread over the mix's other sources in proportion
    (``wanted_share``). Without ``total_tokens`` a mix is as large as it can be with every wanted share met; with it, a
    source that can't reach its share gives all it may. Repeated targets of a source count as one, with shares added and
    the smallest number of repeats; shares that are null or not positive and repeats below one ask for nothing.
    """
    asked = (
        targets.where((F.col("target_share") > 0) & F.col("source").isNotNull())
        .groupBy("mix_name", "source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    have = asked.join(totals, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    most = F.col("available") * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    mix = Window.partitionBy("mix_name")
    share = F.when(most > 0, F.col("target_share")).otherwise(0.0)
    have = have.withColumn("_most", most).withColumn("wanted_share", F.coalesce(F.try_divide(share, F.sum(share).over(mix)), F.lit(0.0)))
    size = F.lit(total_tokens) if total_tokens is not None else F.min(F.when(F.col("wanted_share") > 0, F.col("_most") / F.col("wanted_share"))).over(mix)
    budget = F.least(F.col("_most"), F.floor(F.coalesce(size, F.lit(0)) * F.col("wanted_share") + 1e-6).cast("long"))
    return have.withColumn("budget", F.coalesce(budget, F.lit(0))).drop("_most")


def mix(
    docs: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, vocabulary: str | None = None, total_tokens: int | None = None,
    seed: int = 0, rows_a_range: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """The documents of every mix and the report on its shares.

    Documents: (mix_name, doc_id, source, tokens, uses) for each document that a mix uses, never more than max_repeats
    times. A source's documents are all used as often as they fit its budget whole, and once more in hash-random order for as
    long as the sum stays within it. Report: a row for each target with target_share, wanted_share, documents, available,
    budget, used tokens, actual_share of the mix's tokens and ``most_uses``. An empty table gives shares of zero.
    """
    counted = materialize(token_counts(docs, doc_id, source, text, vocabulary), "tokens")
    totals = materialize(counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available")), "totals")
    plan = materialize(budgets(targets, totals, total_tokens), "budgets")
    asked = plan.where(F.col("budget") > 0).select("mix_name", "source", "available", "budget")
    summed = prefix_sums(counted.join(asked.select("source").distinct(), "source", "left_semi"), totals, seed, rows_a_range)
    rounds = F.expr("budget div available")
    uses = rounds + (F.col("upto") <= F.col("budget") - rounds * F.col("available")).cast("long")
    chosen = summed.join(asked, "source").withColumn("uses", uses).where(F.col("uses") > 0)
    chosen = materialize(chosen.select("mix_name", "doc_id", "source", "tokens", "uses"), "mix")
    spent = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    report = plan.join(spent, ["mix_name", "source"], "left").withColumns({"used": F.coalesce("used", F.lit(0)), "most_uses": F.coalesce("most_uses", F.lit(0))})
    actual = F.coalesce(F.try_divide(F.col("used").cast("double"), F.sum("used").over(Window.partitionBy("mix_name"))), F.lit(0.0))
    return chosen, report.withColumn("actual_share", actual)
