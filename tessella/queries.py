"""Queries of the core operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import impute, profile
from tessella.review_queries import sql_strip
from tessella.sources import raw_lines
from tessella.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records that can't be loaded, with the reason."""
    return raw_lines.rejected(table(spark, sf_dir, "raw_review_lines")).select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other raw records as typed rows."""
    return raw_lines.loaded(table(spark, sf_dir, "raw_review_lines"))


_KEYS = ["review_id", "row_index", "loaded_at"]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every column but the file's name, of any type."""
    reviews = table(spark, sf_dir, "reviews")
    name, ruled = F.col("load"), profile.review_columns()
    columns = ruled + profile.other_columns(reviews, ruled, without=("source_file",))
    return profile.load_changes(
        reviews.withColumn("loaded_on", F.to_date("loaded_at")), "source_file", F.regexp_extract(name, r"^(.*)_\d+\.[^.]*$", 1),
        F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1).try_cast("int"), columns, ["loaded_on"],
    )


def _profiled(changes: DataFrame) -> DataFrame:
    exact = ["rows", "nulls", "distinct_values", "min_value", "max_value", "malformed", "out_of_range", "s0"]
    rounded = [F.round(F.col(x).cast("double"), 6).alias(x) for x in ("s1", "s2", "null_rate", "mean", "deviation", "null_rate_change", "standardised_difference", "shift")]
    return changes.select(F.col("load").alias("source_file"), "column_name", "previous_load", *exact, *rounded)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong or has changed in the four columns with rules of each file, by the profile of all its columns."""
    ruled = [c.name for c in profile.review_columns()]
    return profile.findings(_changes(spark, sf_dir).where(F.col("column_name").isin(ruled))).withColumnRenamed("load", "source_file")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each file's columns of content, with changes against the feed's preceding file."""
    return _profiled(_changes(spark, sf_dir).where(~F.col("column_name").isin(_KEYS)))


def p4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profile of every column, record numbers and load times among them."""
    return _profiled(_changes(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values that other reviews of the author or product can fill."""
    filled = impute.fill_reviews(table(spark, sf_dir, "reviews"))
    return filled.where(F.col("method").isin("group_cluster", "group")).select(F.col("id").alias("review_id"), "column_name")


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing value with its fill and the method that gave it."""
    return impute.fill_reviews(table(spark, sf_dir, "reviews")).withColumnRenamed("id", "review_id")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_loaded, p4_found, p4_profile, p4_columns, p5_found, p5_filled)}


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_WORDS_OF = ["author_id", "skin_tone", "eye_color", "skin_type", "hair_color", "product_id", "product_name", "brand_name"]
_COUNTS_OF = ["total_feedback_count", "total_neg_feedback_count", "total_pos_feedback_count"]
_BARE = lambda c: f"nullif({sql_strip(c)}, '')"
_OTHERS = " union all ".join(
    [f"select source_file, '{c}', {_BARE(c)}, {_BARE(c)} is not null, {_BARE(c)} is not null, null::decimal(20,4) from reviews" for c in _WORDS_OF]
    + [f"select source_file, '{c}', cast({c} as varchar), {c} is not null, {c} is not null, try_cast({c} as decimal(20,4)) from reviews" for c in _COUNTS_OF]
    + [f"select source_file, '{c}', md5({_BARE(c)}), {_BARE(c)} is not null, {_BARE(c)} is not null, cast(length({_BARE(c)}) as decimal(20,4)) from reviews" for c in ("review_text", "review_title")]
    + ["select source_file, 'helpfulness', cast(h as varchar), h is not null, h is not null, cast(h as decimal(20,4)) from (select source_file, try_cast(case when isfinite(helpfulness) then helpfulness end as decimal(20,6)) as h from reviews)"]
)
_P4 = f"""
r as (select source_file, cast(loaded_at as date) loaded_on, {_STRIP.format("rating")} rating, {_STRIP.format("is_recommended")} is_recommended,
      {_STRIP.format("price_usd")} price_usd, {_STRIP.format("submission_time")} submission_time from reviews),
l as (select source_file, loaded_on, 'rating' column_name, nullif(rating, '') v from r
      union all select source_file, loaded_on, 'is_recommended', nullif(is_recommended, '') from r
      union all select source_file, loaded_on, 'price_usd', nullif(price_usd, '') from r
      union all select source_file, loaded_on, 'submission_time', nullif(submission_time, '') from r),
f as (select *, coalesce(case column_name when 'price_usd' then regexp_full_match(v, '-?[0-9]+([.][0-9]{{1,2}})?')
        when 'submission_time' then regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?')
        else regexp_full_match(v, '-?[0-9]+') end, false) formed from l),
n as (select *, case when formed and column_name <> 'submission_time' then try_cast(v as decimal(20,4)) end x from f),
g as (select *, formed and coalesce(case column_name when 'rating' then x between 1 and 5 when 'is_recommended' then x between 0 and 1
        when 'price_usd' then x > 0 and x <= 500
        else try_cast(substr(v, 1, 10) as date) between date '2019-01-01' and loaded_on end, false) ranged from n),
a as (select source_file, column_name, v, formed, ranged, x from g union all {_OTHERS}),
p as (select source_file, column_name, count(*) as rows, count(*) - count(v) nulls, count(distinct v) distinct_values,
      min(v) filter (ranged) min_value, max(v) filter (ranged) max_value,
      count(*) filter (v is not null and not formed) malformed, count(*) filter (formed and not ranged) out_of_range,
      count(x) filter (ranged) s0, sum(x) filter (ranged) s1, sum(cast(x as decimal(18,4)) * cast(x as decimal(18,4))) filter (ranged) s2
      from a group by all),
q as (select *, nulls / rows null_rate, s1::double / nullif(s0, 0) mean from p),
d as (select *, case when s0 > 0 then sqrt(greatest(0, s2::double / s0 - mean * mean)) end deviation from q),
o as (select source_file, lag(source_file) over (partition by regexp_extract(source_file, '^(.*)_[0-9]+[.][^.]*$', 1)
      order by cast(regexp_extract(source_file, '_([0-9]+)[.][^.]*$', 1) as int)) previous_load from (select distinct source_file from r)),
s as (select source_file, column_name, case when column_name = 'price_usd' then least(floor(x / 25), 4) else x end b, count(*) n from g
      where ranged and column_name <> 'submission_time' group by all),
t as (select *, n / sum(n) over (partition by source_file, column_name) part from s),
u as (select o.source_file, t.column_name, t.b, t.part from t join o on o.previous_load = t.source_file),
h as (select source_file, column_name, sum(abs(coalesce(t.part, 0) - coalesce(u.part, 0))) / 2 shift
      from t full join u using (source_file, column_name, b) group by all having count(t.part) > 0 and count(u.part) > 0),
c as (select d.*, o.previous_load, h.shift, d.null_rate - e.null_rate null_rate_change,
      (d.mean - e.mean) / nullif(sqrt((d.deviation ** 2 + e.deviation ** 2) / 2), 0) standardised_difference
      from d join o using (source_file) left join d e on e.source_file = o.previous_load and e.column_name = d.column_name
      left join h on h.source_file = d.source_file and h.column_name = d.column_name)
"""
_KEYED = " union all ".join(
    [f"select source_file, '{c}', cast({c} as varchar), {c} is not null, {c} is not null, try_cast({c} as decimal(20,4)) from reviews" for c in ("review_id", "row_index")]
    + ["select source_file, 'loaded_at', cast(loaded_at as varchar), loaded_at is not null, loaded_at is not null, null::decimal(20,4) from reviews"]
)
_P4_KEYED = _P4.replace(_OTHERS, f"{_OTHERS} union all {_KEYED}").replace("decimal(18,4)", "decimal(19,4)")  # squares of record numbers need more digits
_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_WORDS = ", ".join(f"'{w}'" for w in impute.NOT_GIVEN)
_WORD = f"case when {_KEY} <> '' and {_KEY} not in ({_WORDS}) then 1.0::double end"
_FIRST = r"try_cast(replace(regexp_extract(price_usd, '-?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)', 0), ',', '.') as double)"


_FIELD = r'"(?:[^"]|"")*"|[^",]*'
_RAW_VALUES = ", ".join(f"{sql_strip(f'f[{i}]')} as v{i}" for i in range(1, 20))
_P3 = rf"""with a as (select line_id, raw_line as t, regexp_full_match(raw_line, '(?s)(?:{_FIELD})(?:,(?:{_FIELD}))*') as sound from raw_review_lines),
b as (select *, case when sound then length(regexp_replace(t, '(?s)"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(t, '(?s)"(?:[^"]|"")*"', '', 'g'), ',', '')) + 1 end as fields from a),
c as (select *, list_transform(regexp_extract_all(t, '(?s)(?:^|,)({_FIELD})', 1), lambda x: case when starts_with(x, '"') then replace(x[2:length(x) - 1], '""', '"') else x end) as f from b where sound and fields = 19),
v as (select line_id, {_RAW_VALUES} from c),
ok as (select line_id, regexp_full_match(v1, '[0-9]+') and regexp_full_match(v3, '[1-5]') and regexp_full_match(v4, '[01]?') and (v5 = '' or (regexp_full_match(v5, '[0-9]+([.][0-9]+)?') and try_cast(v5 as double) <= 1))
    and regexp_full_match(v6, '[0-9]*') and regexp_full_match(v7, '[0-9]*') and regexp_full_match(v8, '[0-9]*')
    and (v9 = '' or (regexp_full_match(v9, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?') and try_strptime(v9[1:10], '%Y-%m-%d') is not null))
    and v10 <> '' and (v19 = '' or (regexp_full_match(v19, '[0-9]+([.][0-9]+)?') and try_cast(v19 as double) > 0)) as good from v)
select line_id, reason from (select b.line_id, case when not sound then 'quoting' when fields <> 19 then 'column_count' when not coalesce(good, false) then 'bad_value' end as reason from b left join ok using (line_id)) where reason is not null"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3,
        "p4_found": f"""with {_P4} select source_file, column_name, unnest(list_filter([
            case when malformed > 0.05 * (rows - nulls) then 'pattern' end, case when out_of_range > 0.02 * (rows - nulls) then 'range' end,
            case when abs(null_rate_change) > 0.10 then 'null_rate' end, case when shift > 0.20 then 'shift' end], lambda x: x is not null)) finding from c""",
        "p4_profile": f"""with {_P4} select source_file, column_name, previous_load, rows, nulls, distinct_values, min_value, max_value, malformed,
            out_of_range, s0, round(s1::double, 6) s1, round(s2::double, 6) s2, round(null_rate, 6) null_rate, round(mean, 6) mean,
            round(deviation, 6) deviation, round(null_rate_change, 6) null_rate_change,
            round(standardised_difference, 6) standardised_difference, round(shift, 6) shift from c""",
        "p4_columns": f"""with {_P4_KEYED} select source_file, column_name, previous_load, rows, nulls, distinct_values, min_value, max_value, malformed,
            out_of_range, s0, round(s1::double, 6) s1, round(s2::double, 6) s2, round(null_rate, 6) null_rate, round(mean, 6) mean,
            round(deviation, 6) deviation, round(null_rate_change, 6) null_rate_change,
            round(standardised_difference, 6) standardised_difference, round(shift, 6) shift from c""",
        "p5_found": f"""with r as (select review_id, {_KEY.format("author_id")} a, lower(trim(product_id)) p,
                {_WORD.format("skin_type")} t, {_WORD.format("skin_tone")} s, case when {_FIRST} > 0 then {_FIRST} end m,
                case when not isnan(helpfulness) then helpfulness end h from reviews),
            l as (select review_id, 'skin_type' column_name, a k, t v from r union all select review_id, 'skin_tone', a, s from r
                union all select review_id, 'price_usd', p, m from r union all select review_id, 'helpfulness', p, h from r),
            w as (select *, count(v) over (partition by column_name, k) n from l where k <> '')
            select review_id, column_name from w where v is null and n > 0""",
    }
