"""Data quality profile of the columns of each load, and what changed since the load before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize


@dataclass(frozen=True)
class Checked:
    """How one column is profiled: ``form`` is its pattern (None takes any value), ``in_range`` a test of a well-formed value
    (None takes any), ``number`` its numeric value (or None) and ``share`` the value or band whose shares are compared between loads (or None).
    A ``digest`` column holds long texts: its values are counted by their md5, and its number is their length."""

    name: str
    form: str | None
    in_range: Column | None = None
    number: Column | None = None
    share: Column | None = None
    digest: bool = False


#: What ``\s`` of a pattern with Unicode classes matches; trimming by a list reads only the ends of a text.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _bare(name: str, kind: str) -> Column:
    """A cell as stripped text, null where nothing is left."""
    if kind in ("double", "float"):
        return F.col(name).try_cast("decimal(20,6)").cast("string")
    if kind.split("(")[0] in (*_NUMBERS, "boolean", "date", "timestamp", "timestamp_ntz"):
        return F.col(name).cast("string")
    v = F.btrim(F.col(name).cast("string"), F.lit(_SPACE))
    return F.when(v != "", v)


def value_counts(df: DataFrame, load: str, columns: list[Checked], extra: list[str] | None = None) -> DataFrame:
    """Rows by load, column and value, with ``formed`` and ``ranged``: all later figures merge from these counts.

    A value, column or load with a third of all rows is counted before the shuffle, and rules are only tried on counted values.
    ``in_range`` may use the columns of ``extra``, by which values are counted apart, and ``_v``, the stripped value; null and
    blank are one.
    """
    cells, kinds, extra = [], dict(df.dtypes), extra or []
    for c in columns:
        v = _bare(c.name, kinds[c.name])
        mine = [(F.lit(None).cast(kinds[x]) if c.in_range is None else F.col(x)).alias(x) for x in extra]
        cells.append(F.struct(F.lit(c.name).alias("column_name"), (F.md5(v) if c.digest else v).alias("_v"), (F.length(v) if c.digest else F.lit(None).cast("int")).alias("_length"), *mine))
    long = df.select(F.col(load).alias("load"), F.explode(F.array(*cells)).alias("cell")).select("load", "cell.*")
    values = long.groupBy("load", "column_name", "_v", "_length", *extra).agg(F.count(F.lit(1)).alias("n"))
    formed, number, share = F.col("_v").isNotNull(), F.lit(None).cast("decimal(20,4)"), F.lit(None).cast("string")
    ranged = formed
    for c in columns:
        mine = F.col("column_name") == c.name
        form = F.col("_v").isNotNull() if c.form is None else F.coalesce(F.col("_v").rlike(c.form), F.lit(False))
        if c.form is not None:
            formed = F.when(mine, form).otherwise(formed)
        if c.form is not None or c.in_range is not None:
            ranged = F.when(mine, form if c.in_range is None else form & F.coalesce(c.in_range, F.lit(False))).otherwise(ranged)
        if c.number is not None:
            number = F.when(mine & form, c.number.try_cast("decimal(20,4)")).otherwise(number)
        if c.share is not None:
            share = F.when(mine & form, c.share.cast("string")).otherwise(share)
    return values.select("load", "column_name", F.col("_v").alias("value"), formed.alias("formed"), ranged.alias("ranged"), number.alias("number"), share.alias("share"), "n")


def column_profile(counts: DataFrame) -> DataFrame:
    """One row for each load and column, from ``value_counts``: rows, nulls, exact distinct values, least and greatest
    well-formed value in range, malformed and out-of-range values, and the exact power sums of order 0 to 2 of the numbers in
    range with their mean and deviation."""
    n, ok = F.col("n"), F.col("ranged")
    number = F.when(ok, F.col("number"))
    power = lambda c: F.sum(c.cast("decimal(38,8)"))
    # a product of more than 38 digits would be rounded, so squares are summed by the upper and lower digits of the counts
    square, million = number.try_cast("decimal(15,4)") * number.try_cast("decimal(15,4)"), F.lit(1_000_000)
    base = counts.groupBy("load", "column_name").agg(
        F.sum(n).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("nulls"),
        F.countDistinct("value").alias("distinct_values"),
        F.min(F.when(ok, F.col("value"))).alias("min_value"),
        F.max(F.when(ok, F.col("value"))).alias("max_value"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull() & ~F.col("formed"), n)), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum(F.when(F.col("formed") & ~ok, n)), F.lit(0)).alias("out_of_range"),
        F.coalesce(F.sum(F.when(number.isNotNull(), n)), F.lit(0)).alias("s0"),
        power(number * n).alias("s1"),
        F.sum(square * F.pmod(n, million).cast("decimal(6,0)")).cast("decimal(37,8)").alias("_low"),
        F.sum(square * F.floor(n / million).cast("decimal(6,0)")).cast("decimal(30,8)").alias("_high"),
        F.bool_or(number.isNotNull() & square.isNull()).alias("_too_large"),
    )
    s2 = (F.col("_low") + (F.col("_high") * million.cast("decimal(7,0)")).cast("decimal(37,8)")).cast("decimal(38,8)")
    base = base.withColumn("s2", F.when(~F.col("_too_large"), s2)).drop("_low", "_high", "_too_large")  # no sum that leaves squares out
    mean = F.col("s1").cast("double") / F.col("s0")
    spread = F.greatest(F.lit(0.0), F.col("s2").cast("double") / F.col("s0") - mean * mean)
    known = F.col("rows") - F.col("nulls")
    return (
        base.withColumn("null_rate", F.col("nulls") / F.col("rows"))
        .withColumn("malformed_rate", F.try_divide("malformed", known))
        .withColumn("out_of_range_rate", F.try_divide("out_of_range", known))
        .withColumn("mean", F.when(F.col("s0") > 0, mean))
        .withColumn("deviation", F.when(F.col("s2").isNotNull(), F.sqrt(spread)))
    )


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The counts of two sets of rows as one: what is known of earlier loads, kept as ``value_counts``, and the new ones, which
    alone are read. All figures of ``column_profile`` follow from the sum, distinct values among them."""
    keys = [c for c in stored.columns if c != "n"]
    return stored.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def load_changes(df: DataFrame, load: str, feed: Column, order: Column, columns: list[Checked], extra: list[str] | None = None, stored: DataFrame | None = None) -> DataFrame:
    """``column_profile`` of every load with its changes against the preceding load of its feed.

    Adds previous_load, null_rate_change, standardised_difference of the means (in units of the pooled deviation) and
    ``shift``: half the sum of absolute differences of the shares of each value, null where either load has no value in
    range. The first load of a feed has no changes; an empty table gives no rows. ``stored`` are the counts of earlier loads, which
    are not read again.
    """
    counts = value_counts(df, load, columns, extra)
    counts = materialize(counts if stored is None else merged(stored, counts), "values")
    profile = materialize(column_profile(counts), "profile")
    loads = profile.select("load").distinct().withColumns({"feed": feed, "place": order})
    before = loads.withColumn("previous_load", F.lag("load").over(Window.partitionBy("feed").orderBy("place", "load"))).select("load", "previous_load")
    shared = counts.where(F.col("ranged") & F.col("share").isNotNull())
    byvalue = shared.groupBy("load", "column_name", "share").agg(F.sum("n").alias("n"))
    whole = shared.groupBy("load", "column_name").agg(F.sum("n").alias("whole"))
    shares = materialize(byvalue.join(whole, ["load", "column_name"]).select("load", "column_name", "share", (F.col("n") / F.col("whole")).alias("part")), "shares")
    keys = ["load", "column_name", "share"]
    earlier = shares.withColumnsRenamed({"load": "previous_load", "part": "_before"}).join(before, "previous_load").drop("previous_load")
    both = shares.select("load", "column_name").distinct().join(earlier.select("load", "column_name").distinct(), ["load", "column_name"])
    apart = F.abs(F.coalesce("part", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))
    shift = shares.join(earlier, keys, "full_outer").groupBy("load", "column_name").agg((F.sum(apart) / 2).alias("shift")).join(both, ["load", "column_name"])
    old = profile.select(F.col("load").alias("previous_load"), "column_name", F.col("null_rate").alias("_null"), F.col("mean").alias("_mean"), F.col("deviation").alias("_sd"))
    pooled = F.sqrt((F.col("deviation") * F.col("deviation") + F.col("_sd") * F.col("_sd")) / 2)
    return (
        profile.join(before, "load", "left")
        .join(old, ["previous_load", "column_name"], "left")
        .join(shift, ["load", "column_name"], "left")
        .withColumn("null_rate_change", F.col("null_rate") - F.col("_null"))
        .withColumn("standardised_difference", F.when(pooled > 0, (F.col("mean") - F.col("_mean")) / pooled))
        .drop("_null", "_mean", "_sd")
    )


def findings(changes: DataFrame, malformed: float = 0.05, out_of_range: float = 0.02, nulls: float = 0.10, shift: float = 0.20) -> DataFrame:
    """(load, column_name, finding) where a figure of ``load_changes`` is over its limit."""
    found = F.array_compact(
        F.array(
            F.when(F.col("malformed_rate") > malformed, "pattern"),
            F.when(F.col("out_of_range_rate") > out_of_range, "range"),
            F.when(F.abs("null_rate_change") > nulls, "null_rate"),
            F.when(F.col("shift") > shift, "shift"),
        )
    )
    return changes.select("load", "column_name", F.explode(found).alias("finding"))


def review_columns() -> list[Checked]:
    """The profiled columns of raw reviews; a row's date may not be after its load."""
    v = F.col("_v")
    whole = v.try_cast("int")
    price = v.try_cast("decimal(20,4)")
    date = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
    return [
        Checked("rating", r"^-?[0-9]+$", whole.between(1, 5), whole, whole),
        Checked("is_recommended", r"^-?[0-9]+$", whole.between(0, 1), whole, whole),
        Checked("price_usd", r"^-?[0-9]+(\.[0-9]{1,2})?$", (price > 0) & (price <= 500), price, F.least(F.floor(price / 25), F.lit(4))),
        Checked(
            "submission_time",
            r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?$",
            (date >= F.lit("2019-01-01").cast("date")) & (date <= F.col("loaded_on")),
        ),
    ]


def other_columns(df: DataFrame, ruled: list[Checked], digests: tuple[str, ...] = ("review_text", "review_title"), without: tuple[str, ...] = ()) -> list[Checked]:
    """All other columns, of whatever type, by their text and without rules; those of numbers have numbers."""
    named, v = {c.name for c in ruled} | set(without), F.col("_v")
    out = []
    for name, kind in df.dtypes:
        if name not in named:
            number = v.try_cast("decimal(20,4)") if kind.split("(")[0] in _NUMBERS else None
            out.append(Checked(name, None, None, F.col("_length").cast("decimal(20,4)") if name in digests else number, None, name in digests))
    return out
