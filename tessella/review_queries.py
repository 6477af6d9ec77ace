"""Queries of cleaning, key figures, missing values and samples over the reviews, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cleaning, features, kpi, missing, sampling
from tessella.sources.tables import table

CRITICAL = ["review_text", "is_recommended", "rating", "submission_time", "price_usd"]
DESCRIBED = {
    "review_text": ("required", "rows without text are removed"), "is_recommended": ("required", "rows without a valid value are removed"), "rating": ("required", "must be from 1 to 5"),
    "submission_time": ("required", "needed for trends"), "price_usd": ("product", "cleaned and filled"), "brand_name": ("product", "needed to compare brands"), "product_id": ("product", "needed to rank products"),
    "product_name": ("product", "labels products"), "skin_type": ("customer", "groups customers"), "skin_tone": ("customer", "optional"), "eye_color": ("customer", "optional"), "hair_color": ("customer", "optional"),
    "review_title": ("other", "optional"), "helpfulness": ("other", "optional"),
}
LEVELS = {"brand": ["brand"], "brand_skin_type": ["brand", "skin_type"], "brand_quarter": ["brand", "quarter"]}
SAMPLE, TOP, SEED = 20, 5, 214


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reviews")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_reviews(_raw(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source file."""
    return _raw(spark, sf_dir).groupBy("source_file").agg(F.count(F.lit(1)).alias("raw_rows"))


def clean_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid review once, typed, with its filled price and the usual spelling of its brand."""
    c = _clean(spark, sf_dir)
    return _rounded(c.select("review_id", "rating", "is_recommended", F.date_format("submission_date", "yyyy-MM-dd").alias("submission_date"), "month", "quarter", "price_usd", "price_usd_clean", "brand", "skin_type", "product_name", "brand_product_key"))


def cleaning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of the cleaning removed or set missing."""
    return cleaning.cleaning_log(_raw(spark, sf_dir))


def price_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles and upper fence of the valid reviews' positive prices."""
    df = cleaning.keep_first(cleaning.typed(_raw(spark, sf_dir)), cleaning.KEY_COLUMNS, cleaning.ORDER[:2], "review_id")
    a, b, c = cleaning.valid(df)
    return _rounded(cleaning.fence(df.where(a & b & c), "_price"))


def missing_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of every raw column."""
    return _rounded(missing.missing_by_column(_raw(spark, sf_dir), "raw"))


def missing_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells of the raw table and of the topic features."""
    return _rounded(missing.missing_overview({"raw": _raw(spark, sf_dir), "features": table(spark, sf_dir, "review_level_nmf_feature_table")}, CRITICAL))


def missing_key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values of the key columns with the reason to look at them."""
    return _rounded(missing.missing_of({"raw": _raw(spark, sf_dir)}, DESCRIBED))


def kpi_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of each brand."""
    return _rounded(kpi.kpi_by(_clean(spark, sf_dir), ["brand"]))


def kpi_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of each product of a brand."""
    return _rounded(kpi.kpi_by(_clean(spark, sf_dir), ["brand", "product_id", "product_name"]))


def kpi_by_skin_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of each skin type of a brand."""
    return _rounded(kpi.kpi_by(_clean(spark, sf_dir), ["brand", "skin_type"]))


def kpi_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of each month of a brand."""
    return _rounded(kpi.kpi_by(_clean(spark, sf_dir).where(F.col("month").isNotNull()), ["brand", "month"]))


def kpi_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of each quarter of a brand."""
    return _rounded(kpi.kpi_by(_clean(spark, sf_dir).where(F.col("quarter").isNotNull()), ["brand", "quarter"]))


def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence intervals of brands, their skin types and their quarters."""
    return _rounded(kpi.uncertainty(_clean(spark, sf_dir), LEVELS))


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How steady each brand's months are."""
    return _rounded(kpi.stability(_clean(spark, sf_dir), "brand", "month"))


def skin_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each skin type in its brand."""
    counts = _clean(spark, sf_dir).groupBy("brand", "skin_type").agg(F.count(F.lit(1)).alias("review_count"))
    return _rounded(kpi.shares(counts, ["brand"], "review_count", "share_pct"))


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most reviewed products of each brand."""
    return kpi.top_groups(_clean(spark, sf_dir), "brand", ["product_name", "product_id"], TOP)


def top_product_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews of those products."""
    c = _clean(spark, sf_dir)
    keys = kpi.top_groups(c, "brand", ["product_name", "product_id"], TOP).select("brand", "product_id").distinct()
    return c.join(keys, ["brand", "product_id"], "left_semi").select("review_id", "brand", "product_id")


def brand_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of each brand's reviews, of one size for all."""
    return sampling.sample_by_group(_clean(spark, sf_dir), "brand", "review_id", SAMPLE, SEED).select("brand", "review_id")


def train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact split of all reviews at four fifths."""
    return sampling.split_at(_raw(spark, sf_dir).select("review_id"), "review_id", 0.8, SEED)


def without_dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic features without the dearest hundredth."""
    f = table(spark, sf_dir, "review_level_nmf_feature_table").groupBy("review_id").agg(F.max("price_usd_clean").alias("price_usd_clean"))
    return _rounded(sampling.without_top_share(f, "price_usd_clean", "review_id"))


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of the cleaned reviews add up."""
    return kpi.consistency(_clean(spark, sf_dir), "brand", {"brand": "brand", "skin_type": "skin_type", "quarter": "quarter"}, ["review_text", "is_recommended", "rating", "submission_date"])


def price_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price tier of each cleaned review."""
    return features.price_tiers(_clean(spark, sf_dir), "price_usd_clean").select("review_id", "price_tier")


def queries() -> dict:
    return {f.__name__: f for f in (
        source_rows, clean_reviews, cleaning_log, price_fence, missing_by_column, missing_overview, missing_key_columns, kpi_by_brand, kpi_by_product, kpi_by_skin_type,
        kpi_by_month, kpi_by_quarter, uncertainty, stability, skin_type_shares, top_products, top_product_reviews, brand_sample, train_test, without_dearest, consistency, price_tiers,
    )}


WHITE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^{WHITE}+', ''), '{WHITE}+$', '')"


def sql_number(c: str) -> str:
    return rf"case when regexp_full_match({sql_strip(c)}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast({sql_strip(c)} as double) end"


_S = sql_strip("submission_time")
_DAY = rf"""cast(coalesce(
    case when regexp_full_match({_S}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z?)?') then try_strptime(substr({_S}, 1, 10), '%Y-%m-%d') end,
    case when regexp_full_match({_S}, '[0-9]{{8}}') then try_strptime({_S}, '%Y%m%d') end, case when regexp_full_match({_S}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') then try_strptime({_S}, '%m/%d/%Y') end,
    case when regexp_full_match({_S}, '[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}') then try_strptime({_S}, '%d.%m.%Y') end, case when regexp_full_match({_S}, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') then try_strptime({_S}, '%Y/%m/%d') end,
    case when regexp_full_match({_S}, '[A-Z][a-z]{{2}} [0-9]{{2}}, [0-9]{{4}}') then try_strptime({_S}, '%b %d, %Y') end, case when regexp_full_match({_S}, '[0-9]{{1,2}} [A-Z][a-z]+ [0-9]{{4}}') then try_strptime({_S}, '%d %B %Y') end) as date)"""
_TEXTS = ", ".join(f"{sql_strip(c)} as {c}" for c in cleaning.TEXT_COLUMNS)
CLEAN = rf"""
t0 as (select * replace ({_TEXTS}), {_DAY} as d, {sql_number("rating")} as nr, {sql_number("is_recommended")} as nc, {sql_number("price_usd")} as np from reviews),
t as (select *, case when nr between 1 and 5 then cast(trunc(nr) as int) end as r, case when nc in (0, 1) then cast(nc as int) end as c from t0),
k as (select *, row_number() over (partition by author_id, product_id, submission_time, review_text order by source_file, row_index, review_id) as rn from t),
u as (select * from k where rn = 1),
v as (select * from u where review_text <> '' and c is not null and r is not null),
fe as (select q1, q3, q3 + 3 * (q3 - q1) as upper from (select quantile_cont(np, 0.25) as q1, quantile_cont(np, 0.75) as q3 from v where np > 0)),
w as (select v.*, lower(regexp_replace({sql_strip("brand_name")}, '{WHITE}+', ' ', 'g')) as bk, case when np > 0 and np <= upper then np end as p from v left join fe on true),
bs as (select bk, brand_name as brand from (select bk, brand_name, row_number() over (partition by bk order by count(*) desc, brand_name) as place from w where bk <> '' group by bk, brand_name) where place = 1),
x as (select w.*, bs.brand from w left join bs using (bk)),
m1 as (select product_id, median(p) as m from x where product_id is not null and p is not null group by product_id),
x1 as (select x.*, coalesce(p, m) as p1 from x left join m1 using (product_id)),
m2 as (select brand, median(p1) as m from x1 where brand is not null and p1 is not null group by brand),
x2 as (select x1.*, coalesce(p1, m2.m) as p2 from x1 left join m2 using (brand)),
clean as (select review_id, author_id, product_id, r as rating, c as is_recommended, d as submission_date, strftime(d, '%Y-%m') as month, cast(year(d) as varchar) || 'Q' || cast(quarter(d) as varchar) as quarter,
    p as price_usd, coalesce(p2, (select median(p2) from x2)) as price_usd_clean, brand, coalesce(nullif(skin_type, ''), 'Unknown') as skin_type, coalesce(nullif(product_name, ''), 'Unknown product') as product_name,
    review_title, review_text, coalesce(brand, '') || '||' || coalesce(product_id, '') as brand_product_key from x2)
"""


def _kpi_sql(groups: str, where: str = "true") -> str:
    return f"""with {CLEAN} select {groups}, count(*) as review_count, round(avg(rating), 6) as avg_rating, round(avg(is_recommended) * 100, 6) as recommendation_rate, round(avg(price_usd_clean), 6) as avg_price_usd,
        count(distinct product_id) as unique_products, strftime(min(submission_date), '%Y-%m-%d') as date_min, strftime(max(submission_date), '%Y-%m-%d') as date_max from clean where {where} group by {groups}"""


def _interval_sql(level: str, groups: str, segment: str, where: str) -> str:
    return f"""select '{level}' as level, brand, {segment} as segment, count(*) as review_count, avg(rating) as m, coalesce(stddev_samp(rating), 0) as sd, avg(is_recommended) as p from clean where {where} group by {groups}"""


def oracle_sql() -> dict[str, str]:
    raw_columns = [*cleaning.RECORD_COLUMNS, "review_id", "row_index", "source_file", "loaded_at"]
    gone = lambda c: f"count(*) filter ({c} is null{' or isnan(' + c + ')' if c == 'helpfulness' else ''})"
    feature_columns = ["review_id", "brand", "product_id", "product_name", "skin_type", "price_tier", "price_usd_clean", "review_word_count", "review_title", "review_text", *[f"nmf_topic_{i}_weight" for i in range(1, 9)], "dominant_topic"]
    nan = lambda c: f"count(*) filter ({c} is null{' or isnan(' + c + ')' if c == 'price_usd_clean' or c.startswith('nmf') else ''})"
    by_column = " union all ".join(f"select '{c}' as \"column\", {gone(c)} as missing_count, count(*) as n from reviews" for c in raw_columns)
    by_feature = " union all ".join(f"select '{c}' as \"column\", {nan(c)} as missing_count, count(*) as n from review_level_nmf_feature_table" for c in feature_columns)
    critical = ", ".join(f"'{c}'" for c in CRITICAL)
    key = ", ".join(f"('{c}', '{g}', '{r}')" for c, (g, r) in DESCRIBED.items())
    record = ", ".join(cleaning.RECORD_COLUMNS)
    steps = [("raw_rows", "n0", "n0"), ("drop_exact_duplicate_rows", "n0", "n1"), ("drop_duplicate_review_keys", "n1", "n2"), ("drop_missing_review_text", "n2", "n3"), ("drop_missing_or_invalid_is_recommended", "n3", "n4"), ("drop_rating_outside_1_to_5", "n4", "n5")]
    sets = [("parse_submission_time", "s0"), ("price_not_a_number", "s1"), ("price_not_positive", "s2"), ("price_above_fence", "s3")]
    log = " union all ".join(
        [f"select {i}::int as position, '{s}' as step, {b}::bigint as rows, ({a} - {b})::bigint as removed, 0::bigint as set_missing from a" for i, (s, a, b) in enumerate(steps)]
        + [f"select {6 + i}::int, '{s}', n5::bigint, 0::bigint, {x}::bigint from a" for i, (s, x) in enumerate(sets)]
    )
    hash_order = "md5(concat_ws(':', '{0}', cast(review_id as varchar)))"
    return {
        "source_rows": "select source_file, count(*) as raw_rows from reviews group by source_file",
        "clean_reviews": f"with {CLEAN} select review_id, rating, is_recommended, strftime(submission_date, '%Y-%m-%d') as submission_date, month, quarter, round(price_usd, 6) as price_usd, round(price_usd_clean, 6) as price_usd_clean, brand, skin_type, product_name, brand_product_key from clean",
        "cleaning_log": f"""with {CLEAN}, a as (select (select count(*) from reviews) as n0, (select count(*) from (select distinct {record} from t)) as n1, (select count(*) from u) as n2, (select count(*) from u where review_text <> '') as n3,
            (select count(*) from u where review_text <> '' and c is not null) as n4, (select count(*) from v) as n5, (select count(*) from v where {sql_strip("submission_time")} <> '' and d is null) as s0,
            (select count(*) from v where {sql_strip("price_usd")} <> '' and np is null) as s1, (select count(*) from v where np <= 0) as s2, (select count(*) from v, fe where np > upper) as s3) {log}""",
        "price_fence": f"with {CLEAN} select round(q1, 6) as q1, round(q3, 6) as q3, round(upper, 6) as upper from fe",
        "missing_by_column": f"select 'raw' as dataset, \"column\", missing_count, round(missing_count * 100.0 / n, 6)::double as missing_pct from ({by_column})",
        "missing_overview": f"""select dataset, count(*) as columns_checked, sum(missing_count)::bigint as total_missing_cells, count(*) filter (missing_count > 0) as columns_with_missing,
            coalesce(sum(missing_count) filter ("column" in ({critical})), 0)::bigint as critical_fields_missing_cells, max(n) as rows, round(sum(missing_count) * 100.0 / (max(n) * count(*)), 6)::double as overall_missing_pct
            from (select 'raw' as dataset, * from ({by_column}) union all select 'features', * from ({by_feature})) group by dataset""",
        "missing_key_columns": f"""select "column", 'raw' as dataset, missing_count, round(missing_count * 100.0 / n, 6)::double as missing_pct, field_group, included_reason
            from ({by_column}) join (values {key}) as m("column", field_group, included_reason) using ("column")""",
        "kpi_by_brand": _kpi_sql("brand"),
        "kpi_by_product": _kpi_sql("brand, product_id, product_name"),
        "kpi_by_skin_type": _kpi_sql("brand, skin_type"),
        "kpi_by_month": _kpi_sql("brand, month", "month is not null"),
        "kpi_by_quarter": _kpi_sql("brand, quarter", "quarter is not null"),
        "uncertainty": f"""with {CLEAN}, i as ({_interval_sql("brand", "brand", "'all'", "true")} union all {_interval_sql("brand_skin_type", "brand, skin_type", "skin_type", "skin_type is not null")}
            union all {_interval_sql("brand_quarter", "brand, quarter", "quarter", "quarter is not null")})
            select level, brand, segment, review_count, round(m, 6) as avg_rating, round(greatest(1.0, m - 1.96 * sd / sqrt(review_count)), 6) as avg_rating_low, round(least(5.0, m + 1.96 * sd / sqrt(review_count)), 6) as avg_rating_high,
            round(p * 100, 6) as recommendation_rate, round(greatest(0.0, p * 100 - 1.96 * sqrt(p * (1 - p) / review_count) * 100), 6) as recommendation_rate_low,
            round(least(100.0, p * 100 + 1.96 * sqrt(p * (1 - p) / review_count) * 100), 6) as recommendation_rate_high,
            case when review_count < 30 then 'very small sample' when review_count < 100 then 'small sample' else 'adequate sample' end as note from i""",
        "stability": f"""with {CLEAN}, m as (select brand, month, avg(rating) as a, avg(is_recommended) * 100 as b, count(*) as n from clean where month is not null group by brand, month)
            select brand, count(distinct month) as months, round(stddev_samp(a), 6) as avg_rating_sd, round(stddev_samp(b), 6) as rec_rate_sd, min(n) as min_reviews from m group by brand""",
        "skin_type_shares": f"with {CLEAN} select brand, skin_type, count(*) as review_count, round(count(*) * 100.0 / sum(count(*)) over (partition by brand), 6)::double as share_pct from clean group by brand, skin_type",
        "top_products": f"""with {CLEAN} select * from (select brand, product_name, product_id, count(*) as review_count, cast(row_number() over (partition by brand order by count(*) desc, product_name nulls first, product_id nulls first) as int) as place
            from clean group by brand, product_name, product_id) where place <= {TOP}""",
        "top_product_reviews": f"""with {CLEAN}, q as (select brand, product_id from (select brand, product_name, product_id, row_number() over (partition by brand order by count(*) desc, product_name nulls first, product_id nulls first) as place
            from clean group by brand, product_name, product_id) where place <= {TOP}) select review_id, brand, product_id from clean where exists (select 1 from q where q.brand = clean.brand and q.product_id = clean.product_id)""",
        "brand_sample": f"with {CLEAN} select brand, review_id from (select brand, review_id, row_number() over (partition by brand order by {hash_order.format(SEED)}, review_id) as place from clean) where place <= {SAMPLE}",
        "train_test": f"select review_id, case when row_number() over (order by {hash_order.format(SEED)}, review_id) <= floor(0.8 * (select count(*) from reviews)) then 'train' else 'test' end as part from reviews",
        "without_dearest": """with f as (select review_id, max(price_usd_clean) as price_usd_clean from review_level_nmf_feature_table group by review_id)
            select review_id, round(price_usd_clean, 6) as price_usd_clean from (select *, row_number() over (order by price_usd_clean desc nulls last, review_id) as place from f) where place > greatest(1, ceil(0.01 * (select count(*) from f)))""",
        "consistency": f"""with {CLEAN}, a as (select count(*) as n, count(distinct brand) as b, count(brand) as p1, count(skin_type) as p2, count(quarter) as p3,
            count(*) filter (review_text is null) + count(*) filter (is_recommended is null) + count(*) filter (rating is null) + count(*) filter (submission_date is null) as lacking from clean),
            o as (select 'groups' as "check", b as expected, b as actual from a union all select 'brand_counts_sum_to_rows', n, p1 from a union all select 'skin_type_counts_sum_to_rows', n, p2 from a
            union all select 'quarter_counts_sum_to_rows', n, p3 from a union all select 'required_fields_missing', 0, lacking from a) select *, case when expected = actual then 'PASS' else 'CHECK' end as status from o""",
        "price_tiers": f"""with {CLEAN}, q as (select quantile_cont(price_usd_clean, 1/3.0) as q1, quantile_cont(price_usd_clean, 2/3.0) as q2 from clean)
            select review_id, case when price_usd_clean <= q1 then 'low_price' when price_usd_clean <= q2 then 'mid_price' else 'high_price' end as price_tier from clean, q""",
    }
