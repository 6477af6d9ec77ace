import random

import numpy as np
import pytest

from tessella.llm import pii
from tessella.llm.pii_text import LABELS, Writer

PLAIN = [
    "It pills at the office, so now I only apply it at night.", "My mum told me to try it and I would buy it again.", "The lid is easy to clean and nothing gets wasted.",
    "After two weeks the redness on my chin went down.", "Layers well before bed and the oil never feels sticky.", "I will wait for a sale, the travel size is enough.",
]


@pytest.fixture(scope="module")
def tagger():
    return pii.train(PLAIN * 5, ["Vera Lune", "Third Tide"], written=2500, epochs=4)


def test_values_are_found_in_texts_written_from_another_seed(tagger):
    writer = Writer(99, PLAIN, ["Vera Lune"])
    texts = [writer.text() for _ in range(600)]
    hit, said, true = ({k: 0 for k in range(1, 6)} for _ in range(3))
    for (t, gold), found in zip(texts, tagger.spans([t for t, _ in texts])):
        a, b = {k for *_, k in gold}, {k for *_, k in found}
        for k in range(1, 6):
            hit[k] += k in a and k in b
            said[k] += k in b
            true[k] += k in a
    for k in range(1, 6):
        assert hit[k] >= 0.9 * true[k] and hit[k] >= 0.9 * said[k], (LABELS[k], hit[k], true[k], said[k])


def test_numbers_and_names_that_are_not_personal(tagger):
    texts = ["Order #5612039711 came late.", "Batch 7552-166, use by 03/2024.", "Vera Lune beats the rest.", "SPF 30, 50 ml, 4.5 out of 5", "promo from 12-01-2022 to 12-24-2022", "", "   ", "😊"]
    assert tagger.spans(texts) == [[] for _ in texts]


def test_marginals_equal_the_sum_over_all_labellings(tagger):
    batch = pii.Batch(["call 801 555"], tagger.types)
    scores = tagger.scores(batch).astype(float)
    k, n = len(LABELS), len(scores)
    whole = np.zeros((n, k))
    for code in range(k**n):
        y = [code // k**i % k for i in range(n)]
        s = tagger.first[y[0]] + tagger.last[y[-1]] + sum(scores[i, y[i]] for i in range(n)) + sum(tagger.moves[y[i], y[i + 1]] for i in range(n - 1))
        for i in range(n):
            whole[i, y[i]] += np.exp(s)
    assert np.allclose(tagger.marginals(batch)[0], whole / whole.sum(axis=1, keepdims=True), atol=1e-3)


def test_skip_edges_tie_repeated_rare_words(tagger):
    batch = pii.Batch(["Zelquiv here and zelquiv there and ZELQUIV", "once Zelquiv"], tagger.types)
    assert len(batch.links) == 2 and set(batch.doc[batch.links.ravel()]) == {0}
    held = tagger.skip.copy()
    tagger.skip = np.full_like(held, 4.0)
    tied = tagger.marginals(batch)[0][[0, *batch.links[:, 1]]].argmax(axis=1)
    tagger.skip = held
    assert len(set(tied)) == 1


def test_long_texts_are_read_whole(tagger):
    text = (PLAIN[2] + " ") * 3000 + "write to amara.holsen@example.com please"
    (lo, hi, label), *rest = tagger.spans([text])[0]
    assert not rest and text[lo:hi] == "amara.holsen@example.com" and label == 1


def test_masked_text_nulls_ties_and_empty_tables(spark, tagger):
    random.seed(1)
    rows = [(1, "call me at 801-555-0173", "x"), (1, "call me at 801-555-0173", "x"), (2, None, None), (3, "", "x"), (4, PLAIN[0], "x")]
    df = spark.createDataFrame(rows, "review_id long, text string, types string")
    found = [(r["review_id"], r["types"], r["masked"]) for r in pii.tag(df, "review_id", "text", tagger).collect()]
    assert found == [(1, ["phone"], "call me at [PHONE]")] * 2
    assert pii.personal_information(df.limit(0), "review_id", "text").count() == 0


def test_vocabulary_and_brands_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, texts, epochs: self)
    monkeypatch.setattr(pii, "tag", lambda docs, doc_id, text, tagger: tagger)
    text = "case when id % 4000 = 0 then 'The oil feels zwoel today.' when id % 4000 = 2 and id > 4000 then 'The oil feels zwonk today.' when id = 7 then null else 'This oil feels nice.' end"
    brand = "case when id % 1900 = 0 then ' Vera  Lune' when id % 2110 = 1 then 'Third Tide' end"
    df = spark.range(40_000).selectExpr("id", f"{text} as text", f"{brand} as brand")
    tagger = pii.personal_information(df, "id", "text", "brand")
    assert "zwoel" in tagger.known and "zwonk" not in tagger.known  # 10 and 9 occurrences; 5 in 20,000 texts are known
    assert tagger.brands == {"vera", "lune"}  # 22 and 19 rows; over 19 are a brand


def test_words_and_sentences_do_not_depend_on_how_texts_are_cut(spark):
    texts = [f"Oil number {i % 700} feels w{'abcdefg'[i % 7]} now! And <br />so ΣΑΣ do I.\nA line.<br/>Mail a@b.com or Anna" for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole, a, b = pii.Language(40), *(pii._language(df.repartition(k), "text", 40, 5, 20_000) for k in (1, 9))
    whole.add(texts)
    whole.settle()
    words = pii.Counter(w for t in texts for w in pii.re.findall(r"[^\W\d_]+", t.lower()))
    assert whole.words == words and a == b and a[0] == 3000 and a[1] == {w for w, n in words.items() if n >= 5}
    assert sorted(a[2]) == sorted(whole.drawn) and len(a[2]) == 40 and not any("@" in s or "Anna" in s for s in a[2])


def test_numbers_in_groups_are_no_ordinary_sentences():
    language = pii.Language(100)
    language.add(["QQ 51 15 04 C was printed on it. Reach me on +33 1 99 00 94 88 after six. Paid $70.00 for 50 ml of it. It is sticky."])
    language.settle()
    assert set(language.drawn) == {"Paid $70.00 for 50 ml of it.", "It is sticky."}
