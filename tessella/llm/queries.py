"""The queries of the operators for training data, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import letters_digits, strip
from tessella.llm import baskets, components, encoding, leaks, ledger, mixing, pii
from tessella.sources.tables import table


def _fold(spark: SparkSession, sf_dir: str):
    reviews = table(spark, sf_dir, "reviews")
    batch = F.regexp_extract("source_file", r"_(\d+)\.[^.]*$", 1)
    return reviews, *ledger.fold_batches(reviews.withColumn("_batch", batch), "_batch", "review_id", "author_id", ("review_title", "review_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that are copies of an earlier one of the same author, but for formatting."""
    _, keys, counts = _fold(spark, sf_dir)
    return ledger.copies_of(keys, counts).select(F.col("first_id").alias("first_review_id"), F.col("id").alias("review_id"))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group of copies, with the number of copies."""
    reviews, keys, counts = _fold(spark, sf_dir)
    slim = reviews.select("review_id", "author_id", "source_file")
    return ledger.collapsed(slim, counts, keys, "review_id").select("review_id", "author_id", "source_file", "copies")


def _linked(spark: SparkSession, sf_dir: str):
    reviews = table(spark, sf_dir, "reviews").select("review_id", "is_recommended", letters_digits("author_id").alias("author_key"))
    return reviews, components.account_links(table(spark, sf_dir, "author_links"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that belong together over their authors, in groups of two or more."""
    reviews, links = _linked(spark, sf_dir)
    groups = components.record_groups(reviews, "review_id", "author_key", links)
    return groups.where(F.col("group_size") > 1).select("group_id", F.col("id").alias("review_id"))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review's split, in the proportions of split_targets, tied authors in one split."""
    reviews, links = _linked(spark, sf_dir)
    targets = [(r["split_name"], r["proportion"]) for r in table(spark, sf_dir, "split_targets").orderBy("split_name").collect()]
    positive = F.lower(strip("is_recommended")).isin("1", "1.0", "yes", "y", "true")
    split = components.split_records(reviews, "review_id", "author_key", links, targets, positive)
    return split.select(F.col("id").alias("review_id"), "group_id", "split_name")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual proportion of each split, and its share of recommended reviews."""
    reviews = table(spark, sf_dir, "reviews").select("review_id", (F.lower(strip("is_recommended")).isin("1", "1.0", "yes", "y", "true")).cast("int").alias("yes"))
    s = p2_split(spark, sf_dir).join(reviews, "review_id").groupBy("split_name").agg(F.count(F.lit(1)).alias("reviews"), F.avg(F.coalesce("yes", F.lit(0))).alias("recommended_share"))
    whole = s.agg(F.sum("reviews").alias("_all"))
    targets = table(spark, sf_dir, "split_targets")
    return targets.join(s, "split_name", "left").crossJoin(F.broadcast(whole)).select("split_name", "proportion", "reviews", (F.col("reviews") / F.col("_all")).alias("actual"), "recommended_share")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_information(table(spark, sf_dir, "reviews"), "review_id", "review_text", "brand_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of personal information that each review's text holds."""
    return _tagged(spark, sf_dir).select("review_id", F.explode("types").alias("pii_type"))


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold personal information, with a typed placeholder for each value."""
    return _tagged(spark, sf_dir).select("review_id", F.col("masked").alias("review_text"))


def _item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets.pairs(table(spark, sf_dir, "review_level_nmf_feature_table"), "review_id", ["brand", "price_tier", "skin_type"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of different columns that reviews hold together well above chance."""
    return baskets.above_chance(_item_pairs(spark, sf_dir)).select("item_a", "item_b")


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of items with its number of reviews and its ratio to chance."""
    return _item_pairs(spark, sf_dir).select("item_a", "item_b", "pair_count", F.round("lift", 6).alias("lift"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the item."""
    return leaks.common_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents without the passages, and how many words went."""
    return leaks.without_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text", table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix with how often each is used."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, budget and actual share of tokens of every source of every mix."""
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are wholly or in part misread in a wrong encoding."""
    return encoding.misread(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with their text put right where it can be."""
    return encoding.restored(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_copies, p2_found, p2_split, p2_shares, p6_found, p6_masked, p7_found, p7_pairs, p8_found, p8_removed, p9_mix, p9_shares, p10_found, p10_restored)}


_ITEM = r"'{0}=' || nullif(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '')"
_PAIRS = f"""
i as (select distinct review_id, unnest([{_ITEM.format("brand")}, {_ITEM.format("price_tier")}, {_ITEM.format("skin_type")}]) item
      from review_level_nmf_feature_table where review_id is not null),
c as (select item, count(*) n from i where item is not null group by item),
m as (select count(distinct review_id) records from review_level_nmf_feature_table),
p as (select a.item item_a, b.item item_b, count(*) pair_count from i a join i b using (review_id)
      where a.item < b.item and split_part(a.item, '=', 1) <> split_part(b.item, '=', 1) group by all),
l as (select item_a, item_b, pair_count, records, a.n count_a, b.n count_b from p join c a on a.item = item_a join c b on b.item = item_b, m)
"""
_RUNS = """select {0}, array_to_string(w[x:x + 11], ' ') run from (select {0}, w, unnest(range(1, len(w) - 10)) x
      from (select {0}, list_transform(regexp_extract_all({1}, '[\\p{{L}}\\p{{N}}]+'), lambda y: lower(y)) w from {2}))"""
_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_COPIES = f"""
k as (select review_id, {_KEY.format("author_id")} a, {_KEY.format("review_title")} b, {_KEY.format("review_text")} c from reviews),
g as (select review_id, min(review_id) over (partition by a, least(b, c), greatest(b, c)) first_review_id,
             count(*) over (partition by a, least(b, c), greatest(b, c)) copies
      from k where a <> '' and (b <> '' or c <> ''))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_COPIES} select first_review_id, review_id from g where review_id <> first_review_id",
        "p1_copies": f"""with {_COPIES}
            select r.review_id, r.author_id, r.source_file, cast(coalesce(copies, 1) as bigint) copies
            from reviews r left join g using (review_id) where coalesce(first_review_id, r.review_id) = r.review_id""",
        "p2_found": f"""with recursive
            e0 as (select {_KEY.format("author_id_a")} u, {_KEY.format("author_id_b")} v from author_links),
            e as (select u, v from e0 where u <> '' and v <> '' union select v, u from e0 where u <> '' and v <> ''),
            reach(a, b) as (select u, u from e union select reach.a, e.v from reach join e on reach.b = e.u),
            root as (select a, min(b) root from reach group by a),
            r as (select review_id, {_KEY.format("author_id")} k from reviews),
            g as (select review_id, coalesce(root, k) c from r left join root on k = a where k <> ''),
            s as (select min(review_id) over (partition by c) group_id, review_id, count(*) over (partition by c) n from g)
            select group_id, review_id from s where n > 1""",
        "p7_found": f"with {_PAIRS} select item_a, item_b from l where 200 * pair_count >= records and 2 * pair_count * records >= 3 * count_a * count_b",
        "p7_pairs": f"with {_PAIRS} select item_a, item_b, pair_count, round(pair_count::double * records / (count_a::double * count_b), 6) lift from l",
        "p8_found": f"""with d as ({_RUNS.format("doc_id", "text", "documents")}), e as ({_RUNS.format("item_id", "item_text", "eval_items")})
            select distinct doc_id, item_id from d join e using (run)""",
    }
