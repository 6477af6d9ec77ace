"""Queries of clusters, brands within clusters and rules over the topic features, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import brands, clusters, features, rules, terms
from tessella.operators.cleaning import to_number
from tessella.plans.materialize import materialize, once
from tessella.sources.tables import table
from tessella.text_queries import PLAIN, TOPICS, WORDS, sentiment_sql

PAIRS = [("topic", "price_tier"), ("topic", "skin_type"), ("skin_type", "price_tier")]
CONSEQUENTS = ["recommended", "brand", "rating"]
BASE, STRICT = (0.002, 0.10, 1.05), (0.005, 0.20, 1.05)
KS = {k: f"cluster_k{k}" for k in (3, 4, 5, 6)}
FOCAL = "vera lune"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each review of the feature table with its labels, topics, clusters and outcomes.

    Rows of one id are one review, whose labels are the least of theirs; labels are compared without case and ends.
    """
    f = table(spark, sf_dir, "review_level_nmf_feature_table")
    word = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    labels = [F.min(word(c)).alias(c) for c in ("brand", "skin_type", "price_tier")]
    one = f.groupBy("review_id").agg(*labels, *[F.min(c).alias(c) for c in [*TOPICS, "dominant_topic", "price_usd_clean", "review_word_count"]])
    a = table(spark, sf_dir, "review_cluster_assignments").select("review_id", *KS.values())
    r = table(spark, sf_dir, "reviews")
    rating, rec = to_number("rating"), to_number("is_recommended")
    o = r.select("review_id", F.when(rating.between(1, 5), rating.cast("int")).alias("rating"), F.when(rec.isin(0.0, 1.0), rec.cast("int")).alias("is_recommended"), "review_title", "review_text", F.lit(True).alias("_known"))
    whole = one.join(a, "review_id", "left").join(o, "review_id", "left").withColumn("topic", features.largest_of(TOPICS))
    score = F.when(F.col("_known"), terms.sentiment(terms.combined("review_title", "review_text")))
    return once(whole, "sentiment_score", score).drop("review_title", "review_text", "_known")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, strongest topics and outcomes of each of five clusters."""
    return _rounded(clusters.cluster_profile(segments(spark, sf_dir), "cluster_k5", TOPICS, ["rating", "is_recommended", "sentiment_score"]))


def cluster_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands, skin types and price tiers of each cluster."""
    d = clusters.distributions(segments(spark, sf_dir), "cluster_k5", ["brand", "skin_type", "price_tier"])
    return _rounded(d.drop("distribution"))


def cluster_mix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written out as text."""
    return clusters.distributions(segments(spark, sf_dir), "cluster_k5", ["skin_type", "price_tier"]).select("cluster", "column", "distribution")


def k_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the clusters compare for each number of them, with its silhouette over a sample, best first."""
    s = materialize(segments(spark, sf_dir), "segments")
    table_of = clusters.compare_k(s, KS, "brand")
    parts = None
    for k, c in KS.items():
        one = clusters.sampled_silhouette(s, TOPICS, "review_id", c, sample=300).select(F.lit(k).alias("k"), "silhouette")
        parts = one if parts is None else parts.unionByName(one)
    return _rounded(clusters.choose_k(table_of.join(parts, "k")))


def cluster_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean distance between the centroids of five clusters."""
    return _rounded(clusters.separation(segments(spark, sf_dir), TOPICS, "cluster_k5"))


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reviews nearest to each centroid."""
    return _rounded(clusters.representatives(segments(spark, sf_dir), TOPICS, "cluster_k5", "review_id"))


def scaled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-scores of topics and of the length, and the length stretched from 0 to 100."""
    s = features.z_scores(segments(spark, sf_dir).select("review_id", *TOPICS[:2], "review_word_count"), [*TOPICS[:2], "review_word_count"])
    return _rounded(features.min_max(s, "review_word_count", 0.0, 100.0, "length").select("review_id", *[f"z_{c}" for c in TOPICS[:2]], "z_review_word_count", "length"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each skin type and price tier."""
    s = segments(spark, sf_dir).withColumn("skin_type", features.label("skin_type")).select("review_id", "skin_type", "price_tier")
    return features.one_hot(features.one_hot(s, "skin_type", "skin_type"), "price_tier", "price_tier").drop("skin_type", "price_tier")


def k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clusters by k-means over scaled topics."""
    s = features.z_scores(segments(spark, sf_dir), TOPICS)
    return clusters.k_means(materialize(s, "scaled"), [f"z_{c}" for c in TOPICS], "review_id", 5, 47)[0]


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics on two axes."""
    return clusters.principal(segments(spark, sf_dir), TOPICS, "review_id")


def brand_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands within each of five clusters."""
    return _rounded(brands.brand_profile(segments(spark, sf_dir), "cluster_k5"))


def brand_against_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand against all others in each cluster."""
    return _rounded(brands.against_peers(brands.brand_profile(segments(spark, sf_dir), "cluster_k5"), FOCAL))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("recommended", F.when(F.col("is_recommended") == 1, "yes").when(F.col("is_recommended") == 0, "no").otherwise("unknown"))
    return rules.mine(s, PAIRS, CONSEQUENTS)


def rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every constrained rule."""
    return _rounded(_rules(spark, sf_dir))


def rules_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over the base limits."""
    return _rounded(rules.filtered(_rules(spark, sf_dir), *BASE))


def rule_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered rules by family."""
    return _rounded(rules.families(rules.filtered(_rules(spark, sf_dir), *BASE)))


def rule_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules stay under stricter limits."""
    return _rounded(rules.sensitivity(_rules(spark, sf_dir), BASE, STRICT))


def queries() -> dict:
    return {f.__name__: f for f in (
        cluster_profile, cluster_mix, cluster_mix_text, k_comparison, cluster_separation, cluster_representatives, scaled_topics, one_hot, k_means, principal_components,
        brand_clusters, brand_against_peers, rules_all, rules_filtered, rule_families, rule_sensitivity,
    )}


def _number(c: str) -> str:
    s = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    return rf"case when regexp_full_match({s}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast({s} as double) end"


_WORD = lambda c: f"min(nullif(lower(trim({c}, ' ')), '')) as {c}"
_WEIGHTS = "[" + ", ".join(TOPICS) + "]"
SEGMENTS = f"""
f0 as (select review_id, {_WORD('brand')}, {_WORD('skin_type')}, {_WORD('price_tier')}, {', '.join(f'min({c}) as {c}' for c in [*TOPICS, 'dominant_topic', 'price_usd_clean', 'review_word_count'])}
    from review_level_nmf_feature_table group by review_id),
o0 as (select review_id, {_number('rating')} as nr, {_number('is_recommended')} as nc, {PLAIN} as t, {WORDS} as w from reviews where review_id in (select review_id from f0)),
o as (select review_id, case when nr between 1 and 5 then cast(trunc(nr) as int) end as rating, case when nc in (0, 1) then cast(nc as int) end as is_recommended, {sentiment_sql(terms.POSITIVE, terms.NEGATIVE)} as sentiment_score from o0),
s as (select f0.*, a.* exclude (review_id, brand, product_id, product_name, skin_type, price_tier), o.rating, o.is_recommended, o.sentiment_score, cast(list_position({_WEIGHTS}, list_max({_WEIGHTS})) as int) as topic
    from f0 left join review_cluster_assignments a using (review_id) left join o using (review_id))
"""
_MEANS = ", ".join(f"avg({c}) as {c}" for c in TOPICS)
_APART = lambda a, b: "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) ** 2" for c in TOPICS) + ")"
_PROFILE = f"""{SEGMENTS},
bp as (select cluster_k5 as cluster, brand, count(*) as review_count, sum(rating) as sr, count(rating) as nr, sum(is_recommended) as sc, count(is_recommended) as nc, avg(sentiment_score) as avg_sentiment
    from s where cluster_k5 is not null and brand is not null group by all),
bq as (select cluster, brand, review_count, review_count * 100.0::double / sum(review_count) over (partition by cluster) as brand_share_pct, sr::double / nullif(nr, 0) as avg_rating, sc::double / nullif(nc, 0) * 100 as recommendation_rate, avg_sentiment,
    (sum(sr) over (partition by cluster))::double / nullif(sum(nr) over (partition by cluster), 0) as cluster_avg_rating, (sum(sc) over (partition by cluster)) * 100.0::double / nullif(sum(nc) over (partition by cluster), 0) as cluster_rec_rate from bp),
bz as (select *, brand_share_pct - 100.0::double / (select count(distinct brand) from bp) as over_index_pct from bq)
"""
_MINED = (
    f"{SEGMENTS}, m as (select *, case when is_recommended = 1 then 'yes' when is_recommended = 0 then 'no' else 'unknown' end as recommended from s), e as ("
    + " union all ".join(f"select '{a} + {b} => {c}' as rule_family, '{a}=' || {a} || ' | {b}=' || {b} as antecedent, '{c}=' || {c} as consequent from m where {a} is not null and {b} is not null and {c} is not null" for a, b in PAIRS for c in CONSEQUENTS)
    + """), n as (select rule_family, antecedent, consequent, count(*) as rule_count from e group by all),
    p as (select *, (sum(rule_count) over (partition by rule_family, antecedent))::bigint as antecedent_count, (sum(rule_count) over (partition by rule_family, consequent))::bigint as consequent_count, (select count(*) from m)::double as total from n),
    r as (select rule_family, antecedent, consequent, rule_count / total as support, rule_count::double / antecedent_count as confidence, (rule_count::double / antecedent_count) / (consequent_count / total) as lift, antecedent_count, rule_count, consequent_count / total as consequent_support from p)"""
)


def _limits(limits: tuple[float, float, float]) -> str:
    return f"(support >= {limits[0]} and confidence >= {limits[1]} and lift >= {limits[2]})"


def _silhouette(k: int) -> str:
    c = f"cluster_k{k}"
    return f"""select {k} as k, avg(case when greatest(a, b) > 0 then (b - a) / greatest(a, b) when b is not null then 0.0 end) as silhouette from (
        select i, max(case when own = c then coalesce(d / nullif(n - 1, 0), 0) end) as a, min(case when own <> c then d / n end) as b from (
        select x.review_id as i, x.{c} as own, y.{c} as c, sum({_APART('x', 'y')}) as d, count(*) as n from (select * from s where {c} is not null order by md5('42:' || review_id), review_id limit 300) x,
        (select * from s where {c} is not null order by md5('42:' || review_id), review_id limit 300) y group by all) group by i)"""


def oracle_sql() -> dict[str, str]:
    r6 = lambda *cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)
    themes = ", ".join(f"(select name from l where l.cluster = g.cluster and place = {i}) as theme_{i}, round((select mean from l where l.cluster = g.cluster and place = {i}), 6) as theme_{i}_mean" for i in (1, 2, 3))
    unknown = lambda c: f"coalesce(nullif({c}, ''), 'Unknown / Missing')"
    mix = " union all ".join(f"select cluster_k5 as cluster, '{c}' as \"column\", {unknown(c)} as value, count(*) as n from s where cluster_k5 is not null group by all" for c in ("brand", "skin_type", "price_tier"))
    compare = " union all ".join(f"select {k} as k, {c} as cluster, brand, count(*) as n from s where {c} is not null group by all" for k, c in KS.items())
    rule_columns = "rule_family, antecedent, consequent, " + r6("support", "confidence", "lift") + ", antecedent_count, rule_count, " + r6("consequent_support")
    return {
        "cluster_profile": f"""with {SEGMENTS}, g as (select cluster_k5 as cluster, count(*) as size, avg(rating) as avg_rating, avg(is_recommended) as avg_is_recommended, avg(sentiment_score) as avg_sentiment_score, {_MEANS} from s where cluster_k5 is not null group by cluster_k5),
            l as (select *, row_number() over (partition by cluster order by mean desc, name) as place from (select cluster, round(mean, 9) as mean, name from (unpivot g on {', '.join(TOPICS)} into name name value mean)))
            select cluster, size, round(size * 100.0 / sum(size) over (), 6)::double as share_pct, {r6('avg_rating', 'avg_is_recommended', 'avg_sentiment_score')}, {themes} from g""",
        "cluster_mix": f"""with {SEGMENTS}, x as ({mix}) select cluster, "column", value as dominant, round(pct, 6) as dominant_pct from (select *, n * 100.0::double / sum(n) over (partition by cluster, "column") as pct,
            row_number() over (partition by cluster, "column" order by n desc, value) as place from x) where place = 1""",
        "cluster_mix_text": f"""with {SEGMENTS}, x as ({mix}), y as (select *, n * 100.0::double / sum(n) over (partition by cluster, "column") as pct from x where "column" <> 'brand')
            select cluster, "column", string_agg(value || ' ' || printf('%.1f', pct) || '%', ', ' order by n desc, value) as distribution from y group by "column", cluster""",
        "k_comparison": f"""with {SEGMENTS}, x as ({compare}), e as (select k, cluster, sum(n)::bigint as size, coalesce(max(n) filter (brand is not null), 0) as most from x group by k, cluster),
            h as (select *, size * 100.0::double / sum(size) over (partition by k) as share, most * 100.0::double / size as bs from e),
            t as (select k, count(*) as clusters, min(share) as smallest_pct, max(share) as largest_pct, avg(bs) as avg_dominant_brand_pct, count(*) filter (share < 8) as tiny_clusters, count(*) filter (bs >= 90) as one_brand_clusters from h group by k),
            si as ({' union all '.join(_silhouette(k) for k in KS)}),
            z as (select t.*, silhouette, (case when smallest_pct >= 10 then 2.0 when smallest_pct >= 8 then 1.0 else 0.0 end + case when largest_pct <= 50 then 2.0 when largest_pct <= 55 then 1.0 else 0.0 end + case when avg_dominant_brand_pct <= 55 then 1.0 else 0.0 end
                + case when silhouette >= (select max(silhouette) from si) - 0.03 then 1.5 else 0.0 end + case when t.k = 5 then 0.5 else 0.0 end)::double as score from t join si on si.k = t.k)
            select k, clusters, {r6('smallest_pct', 'largest_pct', 'avg_dominant_brand_pct')}, tiny_clusters, one_brand_clusters, round(silhouette, 6) as silhouette, score, cast(row_number() over (order by score desc, k) as int) as place from z""",
        "cluster_separation": f"with {SEGMENTS}, c as (select cluster_k5, {_MEANS} from s where cluster_k5 is not null group by cluster_k5) select round(coalesce(avg({_APART('a', 'b')}), 0), 6) as separation from c a join c b on a.cluster_k5 < b.cluster_k5",
        "cluster_representatives": f"""with {SEGMENTS}, c as (select cluster_k5, {_MEANS} from s where cluster_k5 is not null group by cluster_k5), d as (select s.cluster_k5 as cluster, review_id, {_APART('s', 'c')} as distance from s join c on s.cluster_k5 = c.cluster_k5)
            select cluster, review_id, round(distance, 6) as distance, cast(place as int) as place from (select *, row_number() over (partition by cluster order by round(distance, 9), review_id) as place from d) where place <= 3""",
        "scaled_topics": f"""with {SEGMENTS} select review_id, """
        + ", ".join(f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) as z_{c}" for c in [*TOPICS[:2], "review_word_count"])
        + ", round((review_word_count - min(review_word_count) over ()) * 100.0::double / (max(review_word_count) over () - min(review_word_count) over ()), 6) as length from s",
        "brand_clusters": f"""with {_PROFILE} select cluster, brand, review_count, {r6('brand_share_pct', 'over_index_pct', 'avg_rating', 'recommendation_rate', 'avg_sentiment', 'cluster_avg_rating', 'cluster_rec_rate')},
            round(avg_rating - cluster_avg_rating, 6) as rating_vs_cluster, round(recommendation_rate - cluster_rec_rate, 6) as rec_vs_cluster from bz""",
        "brand_against_peers": f"""with {_PROFILE}, y as (select cluster, max(brand_share_pct) filter (brand = '{FOCAL}') as share_pct, max(over_index_pct) filter (brand = '{FOCAL}') as over_index_pct, max(avg_rating) filter (brand = '{FOCAL}') as rating, max(recommendation_rate) filter (brand = '{FOCAL}') as rec_rate,
            min(avg_rating) filter (brand <> '{FOCAL}') as peer_min_rating, max(avg_rating) filter (brand <> '{FOCAL}') as peer_max_rating, min(recommendation_rate) filter (brand <> '{FOCAL}') as peer_min_rec, max(recommendation_rate) filter (brand <> '{FOCAL}') as peer_max_rec from bz group by cluster),
            lead as (select cluster, brand as leading_brand from (select *, row_number() over (partition by cluster order by review_count desc, brand desc) as place from bz) where place = 1)
            select y.cluster, {r6('share_pct', 'over_index_pct', 'rating', 'rec_rate', 'peer_min_rating', 'peer_max_rating', 'peer_min_rec', 'peer_max_rec')}, leading_brand, coalesce(rating < peer_min_rating or rec_rate < peer_min_rec or over_index_pct >= 0, false) as weak,
            case when over_index_pct >= 5 then 'over' when over_index_pct <= -5 then 'under' when over_index_pct is not null then 'even' end as index_note from y join lead on lead.cluster = y.cluster""",
        "rules_all": f"with {_MINED} select {rule_columns} from r",
        "rules_filtered": f"with {_MINED} select {rule_columns} from r where {_limits(BASE)}",
        "rule_families": f"with {_MINED} select rule_family, count(*) as rules, round(max(lift), 6) as max_lift, round(max(confidence), 6) as max_confidence, round(max(support), 6) as max_support from r where {_limits(BASE)} group by rule_family",
        "rule_sensitivity": f"""with {_MINED}, z as (select count(*) filter ({_limits(BASE)}) as base_rules, count(*) filter ({_limits(STRICT)}) as strict_rules, count(*) filter ({_limits(BASE)} and {_limits(STRICT)}) as stable_rules from r)
            select *, coalesce(round(stable_rules * 100.0 / nullif(base_rules, 0), 6), 0)::double as stable_share_pct from z""",
    }
