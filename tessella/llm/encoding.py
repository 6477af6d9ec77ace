"""Text misread in a wrong encoding: noisy-channel decoding over byte lattices under the corpus's own frequencies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import materialize
from tessella.plans.skew import join_to_unique

#: The single-byte encodings that text is commonly misread in.
ENCODINGS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "cp852", "cp866", "koi8-r", "iso8859-15", "cp1254"]
LOST = "�"
MARK = "﻿"
#: What taking a span for misread costs against reading its characters as they stand, in nats; the same for each lost byte.
SPAN_COST, LOST_COST = 3.0, 4.0
#: The probability of a character that the corpus holds only in misread spans, and of one that it does not hold, as a share
#: of all characters beyond ASCII.
ODD, UNSEEN = 1e-5, 1e-8
#: How many times as frequent as the form that stands the restored word must be, where bytes alone prove nothing.
WEAK_ODDS = 8.0
DEPTH = 4

_EDGE = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def spans(text: Column) -> Column:
    """The white-space separated spans that hold a character beyond ASCII, without ASCII punctuation at their ends."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0b]+"), lambda s: s.rlike(r"[^\x00-\x7f]"))
    return F.transform(parts, lambda s: F.regexp_replace(s, rf"^{_EDGE}|{_EDGE}$", ""))


def _to_byte(codec: str) -> dict[str, int]:
    """Each character beyond ASCII with its byte; undefined bytes stand for the control character of the same number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


class Channel:
    """Byte lattices of one span and the Viterbi search through them."""

    def __init__(self, letters: dict[str, int]):
        whole = float(sum(letters.values()) or 1)
        self.log = {c: math.log(max(n / whole, ODD)) for c, n in letters.items()}
        self.unseen = math.log(UNSEEN)
        self.bytes = {e: _to_byte(e) for e in ENCODINGS}
        self.chars = {e: {b: c for c, b in t.items()} for e, t in self.bytes.items()}
        self.patterns: dict[tuple, list[str]] = {}
        for c in [*letters, MARK]:
            if ord(c) > 0x7F and c != LOST and not 0xD800 <= ord(c) <= 0xDFFF:
                code = c.encode()
                for lost in range(1, 1 << len(code)):
                    key = tuple(None if lost >> i & 1 else b for i, b in enumerate(code))
                    if any(b is not None for b in key):
                        self.patterns.setdefault(key, []).append(c)
        self.best = {k: max(v, key=lambda c: (self.cost_less(c), c)) for k, v in self.patterns.items()}

    def cost_less(self, c: str) -> float:
        return 0.0 if c < "\x80" else self.log.get(c, self.unseen)

    def viterbi(self, span: str, codec: str) -> tuple[str, int, int]:
        """The likeliest reading of ``span`` if parts of it are UTF-8 bytes read as ``codec``, with its number of misread
        groups and of wildcards in them.

        Nodes are the places between characters. One arc keeps a character as it stands; others take two to four characters
        whose bytes are one UTF-8 character, where a lost byte (U+FFFD) matches any byte of a character of the corpus.
        """
        table, n = self.bytes[codec], len(span)
        code = [None if c == LOST else table.get(c, -1) if c > "\x7f" else ord(c) for c in span]
        score, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for i in range(n):
            here = score[i]
            if (s := here + self.cost_less(span[i])) > score[i + 1]:
                score[i + 1], back[i + 1] = s, (i, span[i], 0, 0)
            if code[i] is not None and code[i] < 0xC2:
                continue
            for size in (2, 3, 4):
                group = code[i : i + size]
                if len(group) < size or -1 in group:
                    break
                if None in group:
                    c = self.best.get(tuple(group))
                    price = LOST_COST
                else:
                    try:
                        c = bytes(group).decode()
                    except UnicodeDecodeError:
                        continue
                    price = 0.0
                if c is None or len(c) != 1:
                    continue
                gain = -price if c == MARK else self.cost_less(c) - price
                if (s := here + gain) > score[i + size]:
                    score[i + size], back[i + size] = s, (i, c, 1, None in group)
        if score[n] - SPAN_COST <= self.likelihood(span):
            return span, 0, 0
        out, at, groups, lost = [], n, 0, 0
        while at:
            at, c, g, w = back[at]
            out.append(c)
            groups += g
            lost += w
        return "".join(reversed(out)), groups, lost

    def readings(self, span: str) -> list[tuple[str, bool]]:
        """The readings of ``span``, each with whether its bytes prove it: UTF-8 groups without lost bytes, at up to four
        levels, prove a misreading; another single-byte encoding does not and must be borne out by word frequencies."""
        found: dict[str, bool] = {}
        now = {span: True}
        for _ in range(DEPTH):
            after: dict[str, bool] = {}
            for text, sure in now.items():
                for codec in ENCODINGS:
                    read, groups, lost = self.viterbi(text, codec)
                    if groups and read != text:
                        after[read] = after.get(read, False) or (sure and not lost)
            after = {r: s for r, s in after.items() if r not in found and r != span}
            if not after:
                break
            found |= after
            now = after
        if not any(found.values()) and LOST not in span:
            beyond = {c for c in span if c > "\x7f"}
            for codec in ENCODINGS:
                table = self.bytes[codec]
                if all(c in table for c in beyond):
                    for other in ENCODINGS:
                        if other != codec:
                            swap = {c: self.chars[other][table[c]] for c in beyond}
                            read = "".join(swap.get(c, c) for c in span)
                            if read != span and not any("\x80" <= c <= "\x9f" for c in read):
                                found.setdefault(read, False)
            for at, c in enumerate(span):  # a lead byte whose second byte was lost with the white space it was read as
                lead = self.bytes["cp1252"].get(c, 0) if c > "\x7f" else 0
                if 0xC3 <= lead <= 0xC5 and (read := self.best.get((lead, None))):
                    found.setdefault(span[:at] + read + span[at + 1 :], False)
        return list(found.items())

    def likelihood(self, text: str) -> float:
        return sum(map(self.cost_less, text))


def mark_proper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows with ``n`` as 0 where all bytes of the span are UTF-8 in one of the encodings."""
    tables = [{ord(c): chr(b) for c, b in _to_byte(e).items()} for e in ENCODINGS]

    def in_any(s: str) -> bool:
        for table in tables:
            try:
                s.translate(table).encode("latin-1").decode()
                return True
            except UnicodeError:
                pass
        return False

    for f in frames:
        yield f.assign(n=[0 if in_any(s) else n for s, n in zip(f["span"], f["n"])])


def candidates(counts: DataFrame, letters: dict[str, int]) -> DataFrame:
    """(span, n, reading, sure, score) for every distinct span that has another reading; score: log likelihood of its
    characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(letters)
        for f in frames:
            rows = [(s, n, r, sure, channel.likelihood(r)) for s, n in zip(f["span"], f["n"]) for r, sure in channel.readings(s)]
            yield pd.DataFrame(rows, columns=["span", "n", "reading", "sure", "score"])

    return counts.select("span", "n").mapInPandas(run, "span string, n long, reading string, sure boolean, score double")


def _shape(c: Column) -> Column:
    """A span with each run of characters beyond ASCII as one lost character."""
    return F.regexp_replace(c, r"[^\x00-\x7f]+", LOST)


def misread_spans(docs: DataFrame, text: str) -> DataFrame:
    """(span, n, reading) of every distinct span of the corpus that is misread; reading is null where it can't be restored.

    Counts of all spans are taken over the whole corpus. A span is misread if its bytes prove it, if it holds a lost or a
    control character, or, with a letter in it, if another single-byte reading is ``WEAK_ODDS`` times as frequent in the corpus. Of
    several readings the most frequent in the corpus is taken, then the likeliest by its characters. Spans with lost
    characters without a reading get the most frequent span of the same ASCII letters, if these are two or more.

    Characters are counted over the spans that no encoding turns into UTF-8, so that many copies of one misread document
    don't make its signs look usual. Only these counts, at most one for each code point, come to the driver.
    """
    counts = materialize(docs.select(F.explode(spans(F.col(text))).alias("span")).where(F.col("span") != "").groupBy("span").agg(F.count(F.lit(1)).alias("n")), "spans")
    chars = counts.mapInPandas(mark_proper, counts.schema).select(F.explode(F.array_distinct(F.split("span", ""))).alias("c"), "n").where(F.col("c").rlike(r"[^\x00-\x7f]"))
    letters = {r["c"]: r["n"] for r in chars.groupBy("c").agg(F.sum("n").alias("n")).collect() if len(r["c"]) == 1}
    read = candidates(counts.repartition(F.col("span")), letters)
    known = counts.select(F.col("span").alias("reading"), F.col("n").alias("known"))
    judged = read.join(known, "reading", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    good = judged.where(F.col("sure") | ((F.col("known") >= WEAK_ODDS * F.col("n")) & F.col("span").rlike(r"\p{L}")))
    best = good.groupBy("span").agg(F.max("n").alias("n"), F.max_by("reading", F.struct("sure", "known", "score", "reading")).alias("reading"))
    broken = F.col("span").rlike("[\u0080-\u0084\u0086-\u009f�]")
    hopeless = counts.where(broken)
    whole = counts.where(~broken).join(best.select("span"), "span", "left_anti").groupBy(_shape(F.col("span")).alias("shape")).agg(F.max_by("span", F.struct("n", "span")).alias("like"))
    guessed = (
        hopeless.withColumn("shape", _shape(F.col("span")))
        .join(whole, "shape", "left")
        .select("span", F.col("n").alias("broken_n"), F.when(F.length(F.regexp_replace("span", "[^A-Za-z]", "")) > 1, F.col("like")).alias("like"))
    )
    both = best.join(guessed, "span", "full_outer").select("span", F.coalesce("n", "broken_n").alias("n"), F.coalesce("reading", "like").alias("reading"))
    return materialize(both, "misread")


def restored(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, restored, complete) of every document that is wholly or in part misread.

    ``restored`` is the text with every misread span put right that can be; ``complete`` says whether all could. Byte-order
    marks are removed. Null and empty texts are no case; other columns are dropped.
    """
    marks = misread_spans(docs, text)
    slim = docs.select(F.col(doc_id).alias("_id"), F.explode(F.array_distinct(spans(F.col(text)))).alias("span"))
    pairs = join_to_unique(slim, marks, ["span"], "n")
    change = F.when(F.col("reading").isNotNull(), F.struct(F.length("span").alias("size"), "span", F.replace("reading", F.lit(MARK), F.lit("")).alias("to")))
    each = pairs.groupBy("_id").agg(F.sort_array(F.collect_set(change), asc=False).alias("changes"), F.bool_and(F.col("reading").isNotNull()).alias("complete"))
    mended = F.aggregate("changes", F.col(text), lambda t, c: F.replace(t, c["span"], c["to"]))
    return docs.select(doc_id, text).join(each, F.col(doc_id) == F.col("_id")).select(doc_id, mended.alias("restored"), "complete")


def misread(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id) of every document that is wholly or in part misread."""
    slim = docs.select(doc_id, F.explode(F.array_distinct(spans(F.col(text)))).alias("span"))
    return join_to_unique(slim, misread_spans(docs, text), ["span"], "n").select(doc_id).distinct()
