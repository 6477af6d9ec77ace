"""Queries of words, weights, sentiment and topics over the reviews' texts, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import features, terms, topics
from tessella.plans.materialize import materialize, once
from tessella.sources.tables import table

TOPICS = [f"nmf_topic_{i}_weight" for i in range(1, 9)]
VOCABULARY, LEAST_DF = 220, 5
#: A lexicon of words that the test reviews hold, beside the default one.
LIKED = "hooked delighted impressed pleased calm relieved favourite glow calmed silky velvety featherlight".split()
DISLIKED = "annoyed unsure torn underwhelmed redness greasy sticky chalky flaking stung cracked leaked wasted".split()


def _text() -> Column:
    return terms.combined("review_title", "review_text")


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "reviews").where(F.length(_text()) > 0)
    return rows, materialize(terms.term_counts(rows, "review_id", _text()), "terms")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each review's title and text."""
    return table(spark, sf_dir, "reviews").select("review_id", F.size(terms.split_words(_text())).alias("words"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent words and pairs of words."""
    return terms.vocabulary(_counts(spark, sf_dir)[1], VOCABULARY, LEAST_DF)


def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the vocabulary's terms in each review."""
    rows, counts = _counts(spark, sf_dir)
    vocab = materialize(terms.vocabulary(counts, VOCABULARY, LEAST_DF), "vocabulary")
    return terms.tf_idf(counts, vocab, rows.count(), "review_id").select("review_id", "term", F.round("weight", 6).alias("weight"))


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon sentiment of each review."""
    score = terms.sentiment(_text(), [*terms.POSITIVE, *LIKED], [*terms.NEGATIVE, *DISLIKED])
    scored = once(table(spark, sf_dir, "reviews"), "score", score)
    return scored.select("review_id", F.round("score", 6).alias("score"), terms.sentiment_label(F.round("score", 9)).alias("label"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short excerpts without brand names."""
    text = terms.excerpt(F.col("review_text"), ["Vera Lune", "Halden Rowe", "Tansy Row"])
    return table(spark, sf_dir, "reviews").select("review_id", text.alias("excerpt"), terms.shorten(F.col("product_name"), 12).alias("product"))


def _factorised(spark: SparkSession, sf_dir: str):
    rows, counts = _counts(spark, sf_dir)
    vocab = materialize(terms.vocabulary(counts, VOCABULARY, LEAST_DF), "vocabulary")
    n = rows.count()
    sparse = topics.term_rows(terms.tf_idf(counts, vocab, n, "review_id"), "review_id")
    return topics.factorise(sparse, vocab.count(), rounds=25), vocab, n


def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic shares of each review."""
    (weights, _, _), _, _ = _factorised(spark, sf_dir)
    shares = weights.select(F.col("id").alias("review_id"), features.row_shares(F.col("w")).alias("s"))
    return shares.select("review_id", *[F.col("s")[i].alias(c) for i, c in enumerate(TOPICS)], F.array_position("s", F.array_max("s")).cast("int").alias("dominant_topic"))


def nmf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest terms of each topic."""
    (_, h, _), vocab, n = _factorised(spark, sf_dir)
    return topics.topic_terms(h, vocab, n)


def nmf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconstruction error after each round."""
    (_, _, errors), _, _ = _factorised(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(errors, 1)), "iteration int, reconstruction_error double")


def dominant_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of largest weight of each feature row, and its share."""
    f = table(spark, sf_dir, "review_level_nmf_feature_table")
    share = F.array_max(features.row_shares(F.array(*[F.col(c) for c in TOPICS])))
    return f.select("review_id", features.largest_of(TOPICS).alias("topic"), F.round(share, 6).alias("share"))


def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, weight, usual brand and skin type and an excerpt of each dominant topic."""
    f = table(spark, sf_dir, "review_level_nmf_feature_table")
    s = topics.topic_summary(f, "dominant_topic", TOPICS, "review_text", "review_id", ["brand", "skin_type"])
    return s.select("dominant_topic", "rows", F.round("mean_weight", 6).alias("mean_weight"), F.round("share_pct", 6).alias("share_pct"), "dominant_brand", "dominant_skin_type")


def queries() -> dict:
    return {f.__name__: f for f in (word_counts, vocabulary, tf_idf, sentiment, excerpts, nmf_topics, nmf_terms, nmf_errors, dominant_topics, topic_summary)}


WHITE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({c}, ''), '^{WHITE}+', ''), '{WHITE}+$', '')"


COMBINED = f"trim({_strip('review_title')} || ' ' || {_strip('review_text')}, ' ')"
PLAIN = f"trim(regexp_replace(lower({COMBINED}), '[^a-z0-9'']+', ' ', 'g'))"
WORDS = f"list_filter(string_split({PLAIN}, ' '), lambda x: x <> '')"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_TERMS = f"""
d as (select review_id, list_filter({WORDS}, lambda x: length(x) >= 3 and x not in {_list(terms.STOP_WORDS)}) as w from reviews where length({COMBINED}) > 0),
e as (select review_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as term from d),
n as (select review_id, term, count(*) as n from e group by all),
v as (select term, count(*) as df, sum(n)::bigint as cf from n group by term having count(*) >= {LEAST_DF} and not regexp_full_match(term, '[0-9]+')),
o as (select *, cast(row_number() over (order by df desc, cf desc, length(term) desc, term) as int) as place from v),
vocab as (select * from o where place <= {VOCABULARY})
"""


def sentiment_sql(positive: list[str], negative: list[str]) -> str:
    phrases = " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) / {len(p)} * {w}" for p, w in terms.PHRASES.items())
    word = f"""case when w[i] in {_list(positive)} then 1.0::double when w[i] in {_list(negative)} then -1.0::double else 0.0::double end
        * case when coalesce(w[greatest(i - 1, 0)], '') in {_list(terms.NEGATORS)} or coalesce(w[greatest(i - 2, 0)], '') in {_list(terms.NEGATORS)} then -1.0::double else 1.0::double end
        * case when coalesce(w[greatest(i - 1, 0)], '') in {_list(terms.INTENSIFIERS)} then 1.35::double else 1.0::double end"""
    return f"case when len(w) = 0 then 0.0::double else (coalesce(list_sum(list_transform(range(1, len(w) + 1), lambda i: {word})), 0) + {phrases}) / (sqrt(len(w)) + 1) end"


def oracle_sql() -> dict[str, str]:
    score = sentiment_sql([*terms.POSITIVE, *LIKED], [*terms.NEGATIVE, *DISLIKED])
    weight = "[" + ", ".join(TOPICS) + "]"
    return {
        "word_counts": f"select review_id, cast(len({WORDS}) as int) as words from reviews",
        "vocabulary": f"with {_TERMS} select term, df, cf, place from vocab",
        "tf_idf": f"""with {_TERMS}, r as (select review_id, term, n::double / max(n) over (partition by review_id) * (ln((1.0 + (select count(*) from d)) / (1 + df)) + 1) as w from n join vocab using (term))
            select review_id, term, round(w / sqrt(sum(w * w) over (partition by review_id)), 6) as weight from r""",
        "sentiment": f"""with s as (select review_id, {PLAIN} as t, {WORDS} as w from reviews), z as (select review_id, {score} as z from s)
            select review_id, round(z, 6) as score, case when round(z, 9) >= 0.22 then 'positive' when round(z, 9) <= -0.22 then 'negative' else 'neutral' end as label from z""",
        "excerpts": rf"""with s as (select review_id, product_name, regexp_replace(regexp_replace(regexp_replace(review_text, '{WHITE}+', ' ', 'g'), '^ ', ''), ' $', '') as t from reviews)
            select review_id, substr(regexp_replace(regexp_replace(regexp_replace(t, 'Vera Lune', '[brand]', 'gi'), 'Halden Rowe', '[brand]', 'gi'), 'Tansy Row', '[brand]', 'gi'), 1, 180) as excerpt,
            case when length(product_name) > 12 then substr(product_name, 1, 9) || '...' else product_name end as product from s""",
        "dominant_topics": f"""select review_id, cast(list_position({weight}, list_max({weight})) as int) as topic, round(list_max({weight}) / case when list_sum({weight}) = 0 then 1 else list_sum({weight}) end, 6) as share
            from review_level_nmf_feature_table""",
        "topic_summary": f"""with f as (select *, {weight}[dominant_topic] as w from review_level_nmf_feature_table where dominant_topic is not null),
            b as (select dominant_topic, brand from (select dominant_topic, brand, row_number() over (partition by dominant_topic order by count(*) desc, brand) as p from f where brand is not null group by dominant_topic, brand) where p = 1),
            s as (select dominant_topic, skin_type from (select dominant_topic, skin_type, row_number() over (partition by dominant_topic order by count(*) desc, skin_type) as p from f where skin_type is not null group by dominant_topic, skin_type) where p = 1),
            g as (select dominant_topic, count(*) as n, avg(w) as w from f group by dominant_topic)
            select g.dominant_topic, n as rows, round(w, 6) as mean_weight, round(n * 100.0 / (select sum(n) from g), 6)::double as share_pct, b.brand as dominant_brand, s.skin_type as dominant_skin_type
            from g left join b on b.dominant_topic = g.dominant_topic left join s on s.dominant_topic = g.dominant_topic""",
    }
