from tessella.llm.encoding import misread, restored

CLEAN = ["Das ist für größere Flächen schön und grün.", "La crème brûlée est très légère.", "Não há solução à vista", "Już po tygodniu skóra mięknie, świetny wynik"]
SCHEMA = "doc_id long, text string, restored string, extra int"


def _frame(spark, texts):
    base = [(i, t, "x", 1) for i, t in enumerate(CLEAN * 60)]
    return spark.createDataFrame(base + [(1000 + i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def _mended(spark, texts):
    return {r["doc_id"] - 1000: r["restored"] for r in restored(_frame(spark, texts), "doc_id", "text").collect()}


def test_one_to_three_levels_of_utf8_come_back_whole(spark):
    texts = []
    for t in CLEAN:
        for codec in ("latin-1", "cp437", "cp850", "mac_roman", "iso8859-2"):
            texts.append((t, t.encode().decode(codec)))
        thrice = t
        for _ in range(3):
            thrice = thrice.encode().decode("latin-1")
        texts.append((t, thrice))
    back = _mended(spark, [bad for _, bad in texts])
    assert [back.get(i) for i in range(len(texts))] == [good for good, _ in texts]


def test_single_byte_misreadings_follow_word_frequencies(spark):
    texts = [(CLEAN[0], CLEAN[0].encode("cp1252").decode("mac_roman")), (CLEAN[3], CLEAN[3].encode("cp1250").decode("latin-1"))]
    back = _mended(spark, [bad for _, bad in texts])
    assert [back[i] for i in range(2)] == [good for good, _ in texts]


def test_lost_characters_and_byte_order_marks(spark):
    back = _mended(spark, ["La cr�me br�l�e", "ï»¿Moja skóra", "�"])
    assert back == {0: "La crème brûlée", 1: "Moja skóra", 2: "�"}


def test_intended_characters_are_no_case(spark):
    fine = ["MANHÃ, NÃO, MAÇÃ", "Glow™ 20 °C ½ scoop, √2 × 3 — “fine”…", "cr&egrave;me &amp; caf&eacute;", "ÂMBAR d’Âne", "", None, " ", "日本語のテキスト", "Это текст", "😊"]
    assert misread(_frame(spark, fine), "doc_id", "text").count() == 0


def test_empty_table_long_text_and_repeats(spark):
    frame = _frame(spark, ["für " * 20_000, "fÃ¼r " * 20_000, "fÃ¼r", "fÃ¼r"])
    assert {r[0] for r in misread(frame, "doc_id", "text").collect()} == {1001, 1002, 1003}
    assert misread(frame.limit(0), "doc_id", "text").count() == 0
    assert restored(frame.limit(0), "doc_id", "text").count() == 0
