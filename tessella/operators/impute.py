"""Filling missing values from similar records: k-prototypes clusters within groups, with fallback and method flags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import letters_digits, one_spaced, strip
from tessella.plans.materialize import discard, materialize
from tessella.plans.skew import join_to_unique

#: The letters and digits of words that only say that a value is not known or not given.
NOT_GIVEN = [
    "unknown", "unknownmissing", "notknown", "na", "none", "null", "nil", "nan", "missing", "notgiven", "notstated", "notspecified", "unspecified",
    "notprovided", "notavailable", "notapplicable", "notsure", "unsure", "notdisclosed", "undisclosed", "undefined", "noanswer",
    "noresponse", "nodata", "prefernottosay", "prefernottoanswer", "rathernotsay", "dontknow", "idontknow", "dk", "tbd", "tba", "blank", "empty",
]


def known_word(c: str) -> Column:
    """The value in lower case and one-spaced; null where null, blank, a mere sign or a word for not known or not given."""
    key = letters_digits(F.col(c))
    return F.when((key != "") & ~key.isin(NOT_GIVEN), one_spaced(F.col(c)))


def first_positive_number(c: str) -> Column:
    """The first number in the text, with its minus sign and point or comma, if above zero, else null."""
    found = F.regexp_extract(F.col(c), r"-?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)", 0)
    value = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value > 0, value)


def not_nan(c: str) -> Column:
    return F.when(~F.isnan(F.col(c)), F.col(c))


@dataclass(frozen=True)
class Target:
    """A column to fill from the records that share ``group``; ``known`` is its observed value or null."""

    column: str
    group: str
    known: Column
    categorical: bool


# --- k-prototypes -----------------------------------------------------------------------------------------------------


def _distance(proto: dict, numbers: list[str], words: list[str], gamma: float) -> Column:
    parts = [F.coalesce(F.pow(F.col(c) - F.lit(float(proto[c])), 2), F.lit(0.0)) for c in numbers if proto.get(c) is not None]
    parts += [F.coalesce(F.when(F.col(c) != proto[c], F.lit(gamma)), F.lit(0.0)) for c in words if proto.get(c) is not None]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def nearest(protos: list[dict], numbers: list[str], words: list[str], gamma: float) -> tuple[Column, Column]:
    """The nearest prototype's index and distance; only observed features count, ties go to the smaller index."""
    cells = [F.struct(_distance(p, numbers, words, gamma).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(protos)]
    best = F.array_min(F.array(*cells))
    return best["i"], best["d"]


def k_prototypes(df: DataFrame, numbers: list[str], words: list[str], id_col: str, k: int = 6, gamma: float = 1.0, rounds: int = 5, tolerance: float = 0.01) -> tuple[DataFrame, list[dict]]:
    """``df`` with its ``cluster``, and the prototypes: means of the observed numbers (scaled to deviation 1) and modes of
    the observed words, over all rows.

    Starts from the k rows of least md5 of the id among those that miss the fewest features, and makes ``rounds`` rounds at
    most, settled or not. Each round is one aggregation to the combinations of cluster and words,
    of which only k rows of means and k times the number of words of modes come to the driver. Ends when the total distance
    falls by less than ``tolerance``. With no rows there are no prototypes and ``cluster`` is 0.
    """
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"s_{c}") for c in numbers]).first()
    scaled = df.withColumns({f"z_{c}": (F.col(c) - F.lit(float(stats[f"m_{c}"] or 0.0))) / F.lit(float(stats[f"s_{c}"] or 0.0) or 1.0) for c in numbers})
    zs = [f"z_{c}" for c in numbers]
    lacks = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in [*zs, *words]])
    start = scaled.select(id_col, *zs, *words).orderBy(lacks, F.md5(F.col(id_col).cast("string")), id_col).limit(k).collect()
    protos = [r.asDict() for r in start]
    if not protos:
        return df.withColumn("cluster", F.lit(0)), []
    last = None
    for _ in range(rounds):
        at, away = nearest(protos, zs, words, gamma)
        sums = [F.sum(z).alias(f"sum_{z}") for z in zs] + [F.count(z).alias(f"n_{z}") for z in zs]
        combos = materialize(
            scaled.select(at.alias("cluster"), away.alias("away"), *zs, *words).groupBy("cluster", *words).agg(F.count(F.lit(1)).alias("n"), F.sum("away").alias("away"), *sums), "combos"
        )
        means = combos.groupBy("cluster").agg(F.sum("away").alias("away"), *[(F.sum(f"sum_{z}") / F.nullif(F.sum(f"n_{z}"), F.lit(0))).alias(z) for z in zs]).collect()
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("word"), F.col(c).alias("value")) for c in words]))
        modes = (
            combos.select("cluster", "n", cells.alias("w")).where(F.col("w.value").isNotNull())
            .groupBy("cluster", "w.word", "w.value").agg(F.sum("n").alias("n"))
            .groupBy("cluster", "word").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")).collect()
        )
        discard(combos)
        for r in means:
            protos[r["cluster"]] = {z: r[z] for z in zs}
        for r in modes:
            protos[r["cluster"]][r["word"]] = r["value"]
        cost = sum(r["away"] for r in means)
        if last is not None and last - cost <= tolerance * last:
            break
        last = cost
    at, _ = nearest(protos, zs, words, gamma)
    return scaled.withColumn("cluster", at).drop(*zs), protos


# --- filling ----------------------------------------------------------------------------------------------------------


def _level(name: str) -> Column:
    return F.col(f"level.{name}").alias(name)


def _bin(c: Column) -> Column:
    """A bin that grows with the number, so that the bins of a group come in the order of its values."""
    return F.signum(c) * F.floor(F.log1p(F.abs(c)) * 64)


def middles(counted: DataFrame) -> DataFrame:
    """(column, key, cluster, word, num): mode or median of every level of ``counted`` (column, key, cluster, word, num, n).

    Levels are the cluster of a group, the group (cluster null), the cluster of all records (key null) and all records
    (both null). Ties of words go to the least. A median is found by the counts of bins first and then in the one or two
    bins that hold it, so a group with any number of different values is never sorted or kept in one task.
    """
    key, cluster, none = F.col("key"), F.col("cluster"), F.lit(None)
    grouped = key.isNotNull()
    levels = F.array_compact(
        F.array(
            *[F.when(ok, F.struct(k.cast("string").alias("key"), c.cast("int").alias("cluster"))) for ok, k, c in ((grouped, key, cluster), (grouped, key, none), (F.lit(True), none, cluster), (F.lit(True), none, none))]
        )
    )
    level = ["column", "key", "cluster"]
    each = (
        counted.where(F.col("word").isNotNull() | F.col("num").isNotNull())
        .select("column", F.explode(levels).alias("level"), "word", "num", "n")
        .select("column", _level("key"), _level("cluster"), "word", "num", "n")
        .groupBy(*level, "word", "num").agg(F.sum("n").alias("n"))
    )
    each = materialize(each, "levels")
    modes = each.where(F.col("word").isNotNull()).groupBy(*level).agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("word")).withColumn("num", F.lit(None).cast("double"))
    values = each.where(F.col("num").isNotNull()).withColumn("bin", _bin(F.col("num")))
    bins = Window.partitionBy(*level).orderBy("bin")
    upto = F.sum("n").over(bins.rowsBetween(Window.unboundedPreceding, 0))
    held = values.groupBy(*level, "bin").agg(F.sum("n").alias("n")).withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy(*level))})
    first, last = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1  # the places of the one or two middle values
    inside = (F.col("upto") >= first) & (F.col("upto") - F.col("n") < last)
    held = held.where(inside).select(*level, "bin", (F.col("upto") - F.col("n")).alias("before"), first.alias("first"), last.alias("last"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*level, "bin"]]
    near = values.alias("a").join(held.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", "before", "first", "last")
    place = F.col("before") + F.sum("n").over(Window.partitionBy(*level, "bin").orderBy("num").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("place", place)
    at = lambda p: F.min(F.when(F.col("place") >= F.col(p), F.col("num")))
    medians = near.groupBy(*level).agg(((at("first") + at("last")) / 2).alias("num")).select(*level, F.lit(None).cast("string").alias("word"), "num")
    return modes.unionByName(medians)


def fill_missing(df: DataFrame, id_col: str, targets: list[Target], numbers: dict[str, Column], words: dict[str, Column], keys: dict[str, Column], k: int = 6) -> DataFrame:
    """Every missing value of ``targets`` with its fill and method, as rows (id, column_name, value, method).

    Values of all targets are counted by column, group, cluster and value in one aggregation, so a group with a third of all
    rows comes to its distinct values. Methods, first that has a value: ``group_cluster`` (same group and cluster), ``group``,
    ``cluster`` (same cluster of all records), ``all``; with no value anywhere the row comes out unfilled with method null.
    Empty keys form no group.
    """
    slim = df.select(
        F.col(id_col),
        *[F.when(c != "", c).alias(f"key_{n}") for n, c in keys.items()],
        *[c.cast("double").alias(f"num_{n}") for n, c in numbers.items()],
        *[c.alias(f"word_{n}") for n, c in words.items()],
        *[t.known.alias(f"known_{t.column}") for t in targets],
    )
    slim = materialize(slim, "slim")
    clustered, _ = k_prototypes(slim, [f"num_{n}" for n in numbers], [f"word_{n}" for n in words], id_col, k)
    cells = [
        F.struct(
            F.lit(t.column).alias("column"), F.col(f"key_{t.group}").alias("key"),
            (F.col(f"known_{t.column}") if t.categorical else F.lit(None)).cast("string").alias("word"),
            (F.lit(None) if t.categorical else F.col(f"known_{t.column}")).cast("double").alias("num"),
        )
        for t in targets
    ]
    long = materialize(clustered.select(F.col(id_col).alias("id"), "cluster", F.explode(F.array(*cells)).alias("c")).select("id", "cluster", "c.*"), "cells")
    counted = materialize(long.groupBy("column", "key", "cluster", "word", "num").agg(F.count(F.lit(1)).alias("n")), "counted")
    middle = materialize(middles(counted), "middles")
    rest = {(r["column"], r["cluster"]): r for r in middle.where(F.col("key").isNull()).collect()}  # a row for each target and cluster
    gone = F.col("word").isNull() & F.col("num").isNull()
    missing = counted.where(gone & F.col("key").isNotNull()).groupBy("column", "key").agg(F.sum("n").alias("missing"))
    parts = F.map_from_entries(F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", F.struct("word", "num")))))
    groups = middle.where(F.col("key").isNotNull()).groupBy("column", "key").agg(
        parts.alias("cells"), F.first(F.when(F.col("cluster").isNull(), F.struct("word", "num")), True).alias("parent")
    )
    groups = materialize(missing.join(groups, ["column", "key"]), "groups")
    lacking = long.where(gone).select("id", "column", "key", "cluster")
    found = join_to_unique(lacking, groups, ["column", "key"], "missing", how="left")
    cell = F.element_at("cells", F.col("cluster"))

    def other(field: str, whole: bool) -> Column:
        kind, out = ("string" if field == "word" else "double"), F.lit(None)
        for (column, cluster), r in rest.items():
            if (cluster is None) == whole:
                here = F.col("column") == column if whole else (F.col("column") == column) & (F.col("cluster") == cluster)
                out = F.when(here, F.lit(r[field])).otherwise(out)
        return out.cast(kind)

    def text(word: Column, num: Column) -> Column:
        return F.coalesce(word, num.cast("string"))

    steps = {
        "group_cluster": text(cell["word"], cell["num"]), "group": text(F.col("parent.word"), F.col("parent.num")),
        "cluster": text(other("word", False), other("num", False)), "all": text(other("word", True), other("num", True)),
    }
    choice = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(m).alias("method"))) for m, v in steps.items()])
    return found.select("id", F.col("column").alias("column_name"), choice.alias("_c")).select("id", "column_name", "_c.value", "_c.method")


def review_numbers() -> dict[str, Column]:
    """The numbers that reviews are clustered on; null where not observed (``least`` and ``greatest`` would skip nulls)."""
    price, feedback = first_positive_number("price_usd"), F.col("total_feedback_count")
    return {
        "rating": F.when(F.col("rating").rlike(r"^\s*[1-5](\.0+)?\s*$"), strip("rating")).try_cast("double"),
        "price": F.when(price.isNotNull(), F.log1p(F.least(price, F.lit(1000.0)))),
        "helpfulness": not_nan("helpfulness"),
        "feedback": F.when(feedback.isNotNull(), F.log1p(F.greatest(feedback, F.lit(0)).cast("double"))),
    }


def fill_reviews(reviews: DataFrame) -> DataFrame:
    """The missing skin_type, skin_tone, price_usd and helpfulness of reviews, filled from their author or product."""
    keys = {"author": letters_digits("author_id"), "product": F.lower(strip("product_id"))}
    targets = [
        Target("skin_type", "author", known_word("skin_type"), True),
        Target("skin_tone", "author", known_word("skin_tone"), True),
        Target("price_usd", "product", first_positive_number("price_usd"), False),
        Target("helpfulness", "product", not_nan("helpfulness"), False),
    ]
    numbers = review_numbers()
    words = {c: known_word(c) for c in ("skin_type", "skin_tone", "eye_color", "hair_color")}
    return fill_missing(reviews, "review_id", targets, numbers, words, keys)
