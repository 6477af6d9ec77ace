"""Cleaning of raw reviews: repeated records, typed values, prices and their filling, with a log of what each step did."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import one_spaced, strip
from tessella.plans.materialize import materialize
from tessella.plans.skew import join_to_unique

#: What makes two records the same review, and which columns make them the same record.
KEY_COLUMNS = ["author_id", "product_id", "submission_time", "review_text"]
RECORD_COLUMNS = [
    "author_id", "rating", "is_recommended", "helpfulness", "total_feedback_count", "total_neg_feedback_count", "total_pos_feedback_count",
    "submission_time", "review_text", "review_title", "skin_tone", "eye_color", "skin_type", "hair_color", "product_id", "product_name", "brand_name", "price_usd",
]
TEXT_COLUMNS = ["review_text", "review_title", "skin_type", "product_id", "product_name", "brand_name"]
ORDER = ["source_file", "row_index", "review_id"]
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

#: The forms in which dates are read, each with its pattern; the first that fits is taken.
DATE_FORMS = {
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}Z?)?$": "yyyy-MM-dd", r"^[0-9]{8}$": "yyyyMMdd", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$": "MM/dd/yyyy",
    r"^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$": "dd.MM.yyyy", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$": "yyyy/MM/dd", r"^[A-Z][a-z]{2} [0-9]{2}, [0-9]{4}$": "MMM dd, yyyy",
    r"^[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}$": "d MMMM yyyy",
}


def to_number(c: Column | str) -> Column:
    """A plain number as double; null where the stripped text is anything else."""
    s = strip(c)
    return F.when(s.rlike(NUMBER), s).try_cast("double")


def to_day(c: Column | str) -> Column:
    """The day of a date in one of ``DATE_FORMS``, the time being dropped; null for other texts and days that don't exist."""
    s = strip(c)
    day = F.when(F.length(s) > 12, F.substring(s, 1, 10)).otherwise(s)
    reads = [F.when(s.rlike(p), F.try_to_date(day if f == "yyyy-MM-dd" else s, f)) for p, f in DATE_FORMS.items()]
    return F.coalesce(*reads)


def same_key(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes that stand for the values of ``columns``, null being a value of its own."""
    text = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2")]


def keep_first(df: DataFrame, columns: list[str], order: list[str], id_col: str) -> DataFrame:
    """``df`` without the rows that agree in ``columns`` with a row that comes before them in ``order``.

    Only hashes, order and ids are shuffled, aggregated before the shuffle, so a record that a third of all rows repeat costs
    one row a task; then the later copies are taken out by id. ``id_col`` must be unique.
    """
    slim = df.select(*same_key(columns), F.col(id_col).alias("_id"), F.struct(*order, id_col).alias("_order"))
    groups = slim.groupBy("_h1", "_h2").agg(F.min("_order").alias("_least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    groups = materialize(groups.select("_h1", "_h2", "_n", F.col(f"_least.{id_col}").alias("_first")), "repeated")
    later = join_to_unique(slim.drop("_order"), groups, ["_h1", "_h2"], "_n").where(F.col("_id") != F.col("_first")).select(F.col("_id").alias(id_col))
    return df.join(later, id_col, "left_anti")


def counted_percentile(df: DataFrame, groups: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact percentiles (linear) of ``value`` for each group, over the counts of its different values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*groups).agg(F.percentile(value, F.array(*[F.lit(float(a)) for a in at]), F.col("_n")).alias("at"))


def common_spelling(df: DataFrame, column: str) -> DataFrame:
    """(key, spelling): the most frequent stripped spelling of each value that differs in case and white space only."""
    s = strip(column)
    counted = df.select(one_spaced(column).alias("key"), s.alias("spelling")).where(F.col("key") != "").groupBy("key", "spelling").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("key").agg(F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("spelling"))


def typed(raw: DataFrame) -> DataFrame:
    """Stripped texts, and rating, is_recommended, price and day as values; what can't be read is null."""
    df = raw.withColumns({c: strip(c) for c in TEXT_COLUMNS})
    recommended, rating, day = to_number("is_recommended"), to_number("rating"), to_day("submission_time")
    return df.withColumns(
        {
            "_recommended": F.when(recommended.isin(0.0, 1.0), recommended.cast("int")), "_rating": F.when(rating.between(1, 5), rating.cast("int")),
            "price_usd_original": F.col("price_usd"), "_price": to_number("price_usd"), "submission_date": day,
            "month": F.date_format(day, "yyyy-MM"), "quarter": F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")),
        }
    )


def fence(prices: DataFrame, price: str, width: float = 3.0) -> DataFrame:
    """(q1, q3, upper): the quartiles of the positive prices and the fence above which a price is an outlier."""
    positive = prices.select(F.when(F.col(price) > 0, F.col(price)).alias("_p"))
    q = counted_percentile(positive, [], "_p", [0.25, 0.75]).select(F.col("at")[0].alias("q1"), F.col("at")[1].alias("q3"))
    return q.withColumn("upper", F.col("q3") + F.lit(width) * (F.col("q3") - F.col("q1")))


def fill_by_medians(df: DataFrame, value: str, out: str, levels: list[str]) -> DataFrame:
    """``df`` with ``out``: ``value``, else the median of its group by the first of ``levels`` that has one, else of all.

    Medians are taken after the levels before have filled. Rows without a group are not filled from each other.
    """
    df = df.withColumn(out, F.col(value))
    for level in levels:
        weight = df.groupBy(level).agg(F.count(F.lit(1)).alias("_rows"))
        medians = counted_percentile(df.where(F.col(level).isNotNull()), [level], out, [0.5]).select(level, F.col("at")[0].alias("_median"))
        medians = materialize(medians.join(weight, level), "medians")
        df = join_to_unique(df, medians, [level], "_rows", how="left").withColumn(out, F.coalesce(out, "_median")).drop("_median")
    whole = counted_percentile(df, [], out, [0.5]).select(F.col("at")[0].alias("_all"))
    return df.crossJoin(F.broadcast(whole)).withColumn(out, F.coalesce(out, "_all")).drop("_all")


def valid(df: DataFrame) -> list[Column]:
    """What a kept review must have, in the order of the steps."""
    return [F.coalesce(F.col("review_text") != "", F.lit(False)), F.col("_recommended").isNotNull(), F.col("_rating").isNotNull()]


def clean_reviews(raw: DataFrame, width: float = 3.0) -> DataFrame:
    """One row for each valid review, typed: later copies (by ``KEY_COLUMNS``) and rows without text, a recommendation of 0
    or 1 or a rating from 1 to 5 are gone; ``price_usd_clean`` is the price between 0 and the fence, else the median of its
    product, brand or all; brands have their most frequent spelling; an empty table stays empty."""
    df = keep_first(typed(raw), KEY_COLUMNS, ORDER[:2], "review_id")
    df = materialize(df.where(reduce(lambda a, b: a & b, valid(df))).drop("rating", "is_recommended", "price_usd").withColumnsRenamed({"_rating": "rating", "_recommended": "is_recommended"}), "valid")
    limit = fence(df, "_price", width)
    kept = F.when((F.col("_price") > 0) & (F.col("_price") <= F.col("upper")), F.col("_price"))
    df = df.crossJoin(F.broadcast(limit)).withColumn("price_usd", kept).drop("_price", "q1", "q3", "upper")
    names = materialize(common_spelling(df, "brand_name").join(df.groupBy(one_spaced("brand_name").alias("key")).agg(F.count(F.lit(1)).alias("_n")), "key"), "brands")
    df = join_to_unique(df.withColumn("key", one_spaced("brand_name")), names, ["key"], "_n", how="left").withColumn("brand", F.col("spelling")).drop("key", "spelling")
    df = fill_by_medians(df, "price_usd", "price_usd_clean", ["product_id", "brand"])
    blank = lambda c, word: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(word))
    df = df.withColumns({"skin_type": blank("skin_type", "Unknown"), "product_name": blank("product_name", "Unknown product")})
    return materialize(df.withColumn("brand_product_key", F.concat(F.coalesce("brand", F.lit("")), F.lit("||"), F.coalesce("product_id", F.lit("")))), "clean")


def cleaning_log(raw: DataFrame, width: float = 3.0) -> DataFrame:
    """(position, step, rows, removed) of every step of ``clean_reviews``, from one count of flags after the copies are gone."""
    df = typed(raw)
    hashed = df.select(*same_key(KEY_COLUMNS), *[h.alias(f"_e{i}") for i, h in enumerate(same_key(RECORD_COLUMNS))])
    each = hashed.groupBy("_h1", "_h2", "_e0", "_e1").agg(F.count(F.lit(1)).alias("n"))
    once = each.groupBy("_h1", "_h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    sizes = once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("exact"), F.count(F.lit(1)).alias("keyed"))
    kept = materialize(keep_first(df, KEY_COLUMNS, ORDER[:2], "review_id"), "kept")
    a, b, c = valid(kept)
    price = F.col("_price")
    good = kept.where(a & b & c)
    upper = fence(good, "_price", width)
    flags = kept.crossJoin(F.broadcast(upper)).agg(
        F.count_if(a).alias("text"), F.count_if(a & b).alias("rec"), F.count_if(a & b & c).alias("rat"),
        F.count_if(a & b & c & (F.length(strip("submission_time")) > 0) & F.col("submission_date").isNull()).alias("dates"),
        F.count_if(a & b & c & (F.length(strip("price_usd")) > 0) & price.isNull()).alias("coerced"),
        F.count_if(a & b & c & (price <= 0)).alias("low"), F.count_if(a & b & c & (price > F.col("upper"))).alias("high"),
    )
    steps = [
        ("raw_rows", "raw", "raw"), ("drop_exact_duplicate_rows", "raw", "exact"), ("drop_duplicate_review_keys", "exact", "keyed"),
        ("drop_missing_review_text", "keyed", "text"), ("drop_missing_or_invalid_is_recommended", "text", "rec"), ("drop_rating_outside_1_to_5", "rec", "rat"),
    ]
    rows = [F.struct(F.lit(i).alias("position"), F.lit(s).alias("step"), F.col(now).alias("rows"), (F.col(was) - F.col(now)).alias("removed"), F.lit(0).cast("long").alias("set_missing")) for i, (s, was, now) in enumerate(steps)]
    rows += [F.struct(F.lit(6 + i).alias("position"), F.lit(s).alias("step"), F.col("rat").alias("rows"), F.lit(0).cast("long").alias("removed"), F.col(n).alias("set_missing")) for i, (s, n) in enumerate([("parse_submission_time", "dates"), ("price_not_a_number", "coerced"), ("price_not_positive", "low"), ("price_above_fence", "high")])]
    return sizes.crossJoin(flags).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
