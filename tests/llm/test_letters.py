from pitlake.llm import decontaminate, language_id

ITEM = "the quick brown fox doesn't jump over a lazy dog while seven more wait in line at home"
CHINESE = "北京是中华人民共和国的首都也是全国的政治文化中心"
THAI = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
SIGNS = ["\u2014 12 \u2014", "5 \u20ac", "\u2022 \u2022", "\U0001f600\u2764\ufe0f", "\u3002\u3002", "\u0663\u0664", "\u2014 \u2026 123 \u20ac", "\u00bd 12 %", "\U0001f600 \U0001f600", "\u3002\u3001\uff01"]


def test_items_with_other_signs_and_scripts_are_found(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, CHINESE), (3, THAI), (4, "\u2014 \u2022")], "item_id long, text string")
    texts = [
        ITEM.replace("'", "\u2019").replace(" ", "\u00a0", 9), f"\u201c{ITEM}\u201d\u2014and more", f"我们知道{CHINESE}。而且", f"ใน{THAI}มี",
        "\u2014 \u2022", "北京很大", ITEM[:30],
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 2), (3, 3)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [4, 5, 6]


def test_texts_without_a_letter_have_no_language(spark):
    rows = [(i, t, l) for i in range(0, 60, 2) for t, l in [("the house and the garden", "en")]] + [(i, "das Haus und der Garten", "de") for i in range(1, 60, 2)]
    rows += [(100 + i, t, None) for i, t in enumerate(SIGNS)] + [(200, "\u2014 H\u00e4user", None), (201, "\u5317\u4eac", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).where("doc_id >= 100").collect()}
    assert all((got[100 + i].lang_pred, got[100 + i].score) == ("und", 0) for i in range(len(SIGNS)))
    assert got[200].lang_pred == "de" and got[201].lang_pred != "und"
    kept = {r.doc_id for r in language_id.keep_identified(docs).where("doc_id >= 100").collect()}
    assert kept == {200, 201}
