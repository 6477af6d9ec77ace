"""Rows that fail to parse: permissive reading under an explicit schema, then the reason for each failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.plans.materialize import once

#: The columns of a raw review file, in order, with the type each is loaded as.
RAW_COLUMNS = {
    "Unnamed: 0": "long", "author_id": "string", "rating": "int", "is_recommended": "int", "helpfulness": "double",
    "total_feedback_count": "long", "total_neg_feedback_count": "long", "total_pos_feedback_count": "long",
    "submission_time": "timestamp_ntz", "review_text": "string", "review_title": "string", "skin_tone": "string",
    "eye_color": "string", "skin_type": "string", "hair_color": "string", "product_id": "string", "product_name": "string",
    "brand_name": "string", "price_usd": "double",
}

#: The most fields that the reader takes in one record; it fails beyond.
MOST_FIELDS = 20480

WHOLE = r"^[0-9]+$"
DECIMAL = r"^[0-9]+(\.[0-9]+)?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?$"


def _number(c: Column, pattern: str, kind: str) -> Column:
    """The value where it has the form, else null; nothing is ever cast that could fail."""
    return F.when(c.rlike(pattern), c).try_cast(kind)


def _optional(c: Column, good: Column) -> Column:
    return (c == "") | F.coalesce(good, F.lit(False))


def value_checks(v: dict[str, Column]) -> dict[str, Column]:
    """For each constrained column, whether its stripped value may be loaded."""
    counts = {c: _optional(v[c], v[c].rlike(WHOLE)) for c in ("total_feedback_count", "total_neg_feedback_count", "total_pos_feedback_count")}
    date = v["submission_time"]
    return {
        "Unnamed: 0": v["Unnamed: 0"].rlike(WHOLE),
        "rating": v["rating"].rlike("^[1-5]$"),
        "is_recommended": v["is_recommended"].rlike("^[01]?$"),
        "helpfulness": _optional(v["helpfulness"], _number(v["helpfulness"], DECIMAL, "double") <= 1),
        "submission_time": _optional(date, date.rlike(DATE) & F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd").isNotNull()),
        "review_text": v["review_text"] != "",
        "price_usd": _optional(v["price_usd"], _number(v["price_usd"], DECIMAL, "double") > 0),
    } | counts


def _quoting(line: Column) -> Column:
    """Whether a record's quoting is ``broken``, and its number of ``fields``.

    Cut at each quote, a sound record has an even number of quotes, and every piece outside them (each second one) is
    empty, which is an escaped quote, or starts with the comma after a closing and ends with that before an opening quote.
    One fold over the pieces carries what it needs, so the work is linear in the text's length, without recursion in a
    regular expression. A line without quotes is sound.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("sound"), F.lit(1).alias("fields"), F.lit(True).alias("opens"))

    def step(s: Column, p: Column) -> Column:
        outside = s["at"] % 2 == 0
        commas = F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))
        starts = (s["at"] == 0) | (p == "") | p.startswith(",")
        sound = s["sound"] & (~outside | (s["opens"] & starts))
        return F.struct(
            (s["at"] + 1).alias("at"), sound.alias("sound"), F.when(outside, s["fields"] + commas).otherwise(s["fields"]).alias("fields"),
            F.when(outside, (p == "") | p.endswith(",")).otherwise(s["opens"]).alias("opens"),
        )

    seen = F.aggregate(F.split(line, '"', -1), start, step)
    return F.transform(F.array(seen), lambda s: F.struct(((s["at"] % 2 == 0) | ~s["sound"]).alias("broken"), s["fields"].alias("fields")))[0]


def read_lines(df: DataFrame, line: str = "raw_line", columns: dict[str, str] | None = None) -> DataFrame:
    """Every record with its fields as strings (struct ``fields``), ``corrupt`` raw text and ``reason``.

    Records are read permissively under an explicit schema; what the reader refuses keeps its raw text. Reasons are then
    found for every record, as the reader lets some broken ones pass: ``quoting``, ``column_count``, ``bad_value``, the
    first that holds, else null. A null record counts as empty and so has a wrong column count; other columns of ``df`` are
    kept, but for those named fields, corrupt or reason, which get the suffix ``_given``. A record with more fields than the
    reader takes is not given to it: its ``fields`` are null and its raw text and reason are kept like any other's.
    """
    columns = columns or RAW_COLUMNS
    names = {name: f"c{i}" for i, name in enumerate(columns)}
    schema = ", ".join(f"{c} string" for c in names.values()) + ", corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(MOST_FIELDS), "nullValue": "\x00", "emptyValue": ""}
    kept = df.withColumnsRenamed({c: f"{c}_given" for c in ("fields", "corrupt", "reason") if c in df.columns})
    text = F.coalesce(F.col(line), F.lit(""))
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    seen = once(kept, "_seen", _quoting(text))
    broken, count = F.col("_seen.broken"), F.col("_seen.fields")
    readable = (commas < MOST_FIELDS - 1) | (~broken & (count < MOST_FIELDS))
    read = once(seen, "fields", F.from_csv(F.when(readable, text), schema, options))
    needed = list(value_checks({name: F.lit("") for name in names}))
    stripped = [strip(F.coalesce(F.col("fields")[names[n]], F.lit(""))).alias(names[n]) for n in needed]
    read = once(read, "_value", F.struct(*stripped))
    checks = value_checks({n: F.col("_value")[names[n]] for n in needed})
    bad = reduce(lambda a, b: a | b, [~ok for ok in checks.values()])
    reason = F.when(broken, "quoting").when(count != len(columns), "column_count").when(bad, "bad_value")
    judged = once(read, "reason", reason)
    return judged.withColumn("corrupt", F.when(F.col("reason").isNotNull(), F.coalesce(F.col("fields.corrupt"), text))).drop("_seen", "_value")


def rejected(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """The records that can't be loaded, with ``reason`` and ``corrupt`` raw text."""
    return read_lines(df, line).where(F.col("reason").isNotNull()).drop("fields")


def loaded(df: DataFrame, line: str = "raw_line", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """All other records as typed rows; empty values become null.

    A good value that its type can't hold, such as a count over 2^63, is null too, and its text is kept under its column's
    name in the map ``unfit``, which is null where every value fits.
    """
    rows = read_lines(df, line).where(F.col("reason").isNull())
    typed, unfit = [], []
    for i, (name, kind) in enumerate(RAW_COLUMNS.items()):
        value = F.col("fields")[f"c{i}"]
        if kind != "string":
            value = strip(value)
        value = F.when(value != "", value)
        typed.append((value if kind == "string" else value.try_cast(kind)).alias(name))
        if kind != "string":
            unfit.append(F.when(value.isNotNull() & value.try_cast(kind).isNull(), F.struct(F.lit(name).alias("column"), value.alias("text"))))
    lost = F.array_compact(F.array(*unfit))
    return rows.select(*keep, *typed, F.when(F.size(lost) > 0, F.map_from_entries(lost)).alias("unfit"))
