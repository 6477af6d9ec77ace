"""Words, pairs of words, their frequencies and TF-IDF weights, and lexicon sentiment; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import strip

#: Words that carry no topic.
STOP_WORDS = """
a about after all also am amazing an and any are as at be because been before best better but by can definitely did didn do does
doesn don even every face feel feels first for from get good got great had has have he her his how i if in is it its just like
little love made make makes me more most much my nice night not now of on one only or other our out product products really
recommend recommended recommending sephora she skin so still super than that the their them then there these they thing things
this time to too tried try use used using very was we well were when will with work works worth would you your day
""".split()

#: The sentiment lexicon, words that turn or strengthen what follows, and weighted phrases.
NEGATORS = "not no never hardly rarely without isnt wasnt dont didnt cant couldnt wont".split()
INTENSIFIERS = "very really super so extremely quite too".split()
POSITIVE = """
amazing balanced beautiful best bright brightening calm calming clean clear comfort comfortable dewy effective favorite favourite
firm gentle glow glowy great happy heal help helped helps holy hydrated hydrating hydration improve improved improvement love
loving moisturized moisturizing perfect plump recommend recommended repurchase smooth smoothed soft softer soothing worth
""".split()
NEGATIVE = """
acne broke breakout breakouts bumps burn burning clogged congestion costly damage damaged dry drying expensive flare flaking
greasy harsh heavy irritated irritating irritation itchy oily painful patchy pilling pricey rash red redness residue sensitive
sticky stinging stings stripped tight waste worse worst
""".split()
PHRASES = {
    "holy grail": 2.0, "worth the money": 1.7, "works well": 1.3, "highly recommend": 1.8, "love this": 1.5, "gentle cleanser": 1.3,
    "left my skin soft": 1.6, "little goes a long way": 1.5, "broke me out": -2.1, "too drying": -1.6, "too expensive": -1.4,
    "did not work": -1.8, "not worth": -1.5, "made me break out": -2.2, "left a residue": -1.4, "stung my skin": -1.8, "caused irritation": -1.9,
}


def combined(title: str, body: str) -> Column:
    """Title and text, stripped, one space between; null counts as empty."""
    return F.trim(F.concat_ws(" ", F.coalesce(strip(title), F.lit("")), F.coalesce(strip(body), F.lit(""))))


def plain(c: Column) -> Column:
    """Lower case, everything but ASCII letters, digits and apostrophes as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9']+", " "))


def split_words(c: Column) -> Column:
    return F.filter(F.split(plain(c), " "), lambda w: w != "")


def terms(c: Column, stop: list[str] | None = None, shortest: int = 3) -> Column:
    """The words of at least ``shortest`` letters that are no stop words, then each pair of neighbours among those left."""
    kept = F.filter(split_words(c), lambda w: (F.length(w) >= shortest) & ~w.isin(STOP_WORDS if stop is None else stop))

    def both(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))

    return F.transform(F.array(kept), both)[0]


def term_counts(df: DataFrame, id_col: str, text: Column, stop: list[str] | None = None) -> DataFrame:
    """(id, term, count) of every term of every row."""
    return df.select(id_col, F.explode(terms(text, stop)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(counts: DataFrame, most: int = 220, least_df: int = 5) -> DataFrame:
    """(term, df, cf, place): the ``most`` terms of the largest document frequency, corpus frequency and length, ties by the
    term, among those in ``least_df`` rows at least that are no numbers."""
    freq = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("count").alias("cf"))
    top = freq.where((F.col("df") >= least_df) & ~F.col("term").rlike("^[0-9]+$")).orderBy(F.desc("df"), F.desc("cf"), F.desc(F.length("term")), "term").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("df"), F.desc("cf"), F.desc(F.length("term")), "term")))


def tf_idf(counts: DataFrame, vocab: DataFrame, rows: int, id_col: str) -> DataFrame:
    """(id, place, term, weight): count over the row's largest count, times ln((1 + rows) / (1 + df)) + 1, each row's weights
    of length 1. The vocabulary is bounded by its ``most``, so it is broadcast; rows without its terms don't come out."""
    kept = counts.join(F.broadcast(vocab), "term")
    row = Window.partitionBy(id_col)
    raw = kept.withColumn("_w", F.col("count") / F.max("count").over(row) * (F.log((F.lit(1.0) + rows) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(row))).select(id_col, "place", "term", "weight")


def sentiment(c: Column, positive: list[str] | None = None, negative: list[str] | None = None, negators: list[str] | None = None, intensifiers: list[str] | None = None, phrases: dict[str, float] | None = None) -> Column:
    """Weighted phrases plus words of +1 and -1, turned by a negator among the two words before and times 1.35 after an
    intensifier, over the root of the number of words plus one; a text without words gives 0."""
    positive, negative = positive or POSITIVE, negative or NEGATIVE
    negators, intensifiers, phrases = negators or NEGATORS, intensifiers or INTENSIFIERS, PHRASES if phrases is None else phrases

    def of(s: Column) -> Column:
        text, words = s["text"], s["words"]
        before = lambda i, k: F.coalesce(F.get(words, i - k), F.lit(""))

        def score(w: Column, i: Column) -> Column:
            base = F.when(w.isin(positive), 1.0).when(w.isin(negative), -1.0).otherwise(0.0)
            turned = F.when(before(i, 1).isin(negators) | before(i, 2).isin(negators), -1.0).otherwise(1.0)
            return base * turned * F.when(before(i, 1).isin(intensifiers), 1.35).otherwise(1.0)

        total = F.aggregate(F.transform(words, score), F.lit(0.0), lambda a, x: a + x)
        for phrase, weight in phrases.items():
            total = total + (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase) * weight
        return F.when(F.size(words) == 0, 0.0).otherwise(total / (F.sqrt(F.size(words).cast("double")) + 1))

    # text and words are bound to a variable, so that they are made once for each row and not for each word
    text = plain(F.coalesce(c, F.lit("")))
    return F.transform(F.transform(F.array(text), lambda t: F.struct(t.alias("text"), F.filter(F.split(t, " "), lambda w: w != "").alias("words"))), of)[0]


def sentiment_label(score: Column, limit: float = 0.22) -> Column:
    return F.when(score >= limit, "positive").when(score <= -limit, "negative").otherwise("neutral")


def excerpt(c: Column, names: list[str], mark: str = "[brand]", longest: int = 180) -> Column:
    """One-spaced text without ``names`` in any case, cut at ``longest``."""
    out = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    for n in names:
        quoted = "".join(f"\\{ch}" if not ch.isalnum() and ch.isascii() else ch for ch in n)
        out = F.regexp_replace(out, f"(?iu){quoted}", mark)
    return F.substring(out, 1, longest)


def shorten(c: Column, longest: int) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)
