from tessella.llm.leaks import common_passages

ITEM = [f"word{i}" for i in range(40)]


def _found(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(ITEM)), (2, "À la Été, " + " ".join(ITEM[:11])), (3, None)], "item_id long, item_text string")
    return {tuple(r) for r in common_passages(d, "doc_id", "text", i, "item_id", "item_text").collect()}


def test_runs_of_twelve_at_any_place(spark):
    docs = [(100 * before + at, " ".join(["x"] * before + ITEM[at : at + 12] + ["y"] * (at % 3))) for before in range(15) for at in (0, 5, 28)]
    assert _found(spark, docs) == {(d, 1) for d, _ in docs}


def test_eleven_words_are_none(spark):
    docs = [(n, " ".join(["x"] * n + ITEM[3:14] + ["y"] * 5)) for n in range(15)] + [(90, None), (91, "")]
    assert _found(spark, docs) == set()


def test_case_and_signs_do_not_count(spark):
    assert _found(spark, [(5, "z à-LA;ÉTÉ... " + "_ ".join(w.upper() for w in ITEM[:9]))]) == {(5, 2)}


def test_passages_are_removed_and_the_rest_stays(spark):
    from tessella.llm.leaks import without_passages

    docs = [(1, "Before, " + " ".join(ITEM[3:20]) + "! After."), (2, "clean"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(ITEM))], "item_id long, item_text string")
    assert [tuple(r) for r in without_passages(d, "doc_id", "text", i, "item_id", "item_text").collect()] == [(1, [7], "Before, ! After.", 17)]
