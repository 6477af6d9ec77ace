import random
import time

from tessella.sources.raw_lines import loaded, rejected

GOOD = '{0},a,5,1,0.5,3,1,2,2020-01-01,"{1}",t,,,,,p,n,b,9.5'


def _lines(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")


def test_records_with_more_fields_than_the_reader_takes(spark):
    many = "," * 30_000
    df = _lines(spark, GOOD.format(1, "fine"), many, '"' + many, GOOD.format(2, many), "x" * 50_000 + ',"y' + many + "z")
    found = {r["line_id"]: (r["reason"], r["corrupt"]) for r in rejected(df).collect()}
    texts = [r["raw_line"] for r in df.orderBy("line_id").collect()]
    assert found == {1: ("column_count", texts[1]), 2: ("quoting", texts[2]), 4: ("quoting", texts[4])}
    assert {r["line_id"]: r["review_text"] for r in loaded(df).collect()} == {0: "fine", 3: many}


def test_numbers_too_large_for_their_type_keep_their_text(spark):
    big = "9223372036854775808"
    df = _lines(spark, GOOD.format(big, "x"), GOOD.format(9223372036854775807, "y"), GOOD.format(7, "z").replace(",3,1,2,", f",3,,{big},"))
    found = {r["line_id"]: (r["Unnamed: 0"], r["total_pos_feedback_count"], r["unfit"]) for r in loaded(df).collect()}
    assert found == {0: (None, 2, {"Unnamed: 0": big}), 1: (9223372036854775807, 2, None), 2: (7, None, {"total_pos_feedback_count": big})}


def test_quoting_is_linear_and_as_by_hand(spark):
    def by_hand(s):
        at, n = 0, 0
        while True:
            n += 1
            if s[at : at + 1] == '"':
                at += 1
                while True:
                    end = s.find('"', at)
                    if end < 0:
                        return "quoting"
                    if s[end : end + 2] == '""':
                        at = end + 2
                        continue
                    at = end + 1
                    break
                if at < len(s) and s[at] != ",":
                    return "quoting"
            else:
                end = s.find(",", at)
                end = len(s) if end < 0 else end
                if '"' in s[at:end]:
                    return "quoting"
                at = end
            if at >= len(s):
                return None if n == 19 else "column_count"
            at += 1

    r = random.Random(5)
    lines = ["".join(r.choice('",,a"') for _ in range(r.randint(0, 14))) for _ in range(3000)] + ['"a""b",' * 18 + "x", '"",' * 18 + '""', "," * 18]
    found = {x["line_id"]: x["reason"] for x in rejected(_lines(spark, *lines)).collect()}
    for i, s in enumerate(lines):
        want = by_hand(s) or "bad_value"
        assert found[i] == want, (s, want, found[i])
    began = time.time()
    assert rejected(_lines(spark, '"a",' * 60_000)).count() == 1
    assert time.time() - began < 30


def test_nulls_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x", "y"), (2, GOOD.format(3, "t"), "x", "y")], "line_id long, raw_line string, reason string, fields string")
    assert [(r["line_id"], r["reason"], r["reason_given"], r["fields_given"]) for r in rejected(df).collect()] == [(1, "column_count", "x", "y")]
    assert rejected(df.limit(0)).count() == loaded(df.limit(0)).count() == 0
