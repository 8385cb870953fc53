import pytest
from pyspark.sql import functions as F

from lingloom.llm import sentences as S


def split(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["s"] for r in rows.select("i", S.sentences(F.col("t")).alias("s")).orderBy("i").collect()]


CASES = {
    "abbreviations": ("Dr. Smith met T. Zojo at 5 p.m. because of No. 7. They left at 6 p.m. The end.", ["Dr. Smith met T. Zojo at 5 p.m. because of No. 7.", "They left at 6 p.m.", "The end."]),
    "numbers": ("It cost 3.5 dollars. Version v2.1.0 is out.", ["It cost 3.5 dollars.", "Version v2.1.0 is out."]),
    "addresses": ("See www.a.example/8.html. Then go on.", ["See www.a.example/8.html.", "Then go on."]),
    "attribution": ("“One thing. Another thing,” said Ann. Next one.", ["“One thing. Another thing,” said Ann.", "Next one."]),
    "brackets": ("(One here.) Two (see no. 4 in the list) here! Three?!", ["(One here.)", "Two (see no. 4 in the list) here!", "Three?!"]),
    "no blank": ("It was 4 km.Reviewed by Ann… Then more.", ["It was 4 km.", "Reviewed by Ann…", "Then more."]),
    "headings": ("1. A heading\nA line without mark\n\nA sentence. Another", ["1. A heading", "A line without mark", "A sentence.", "Another"]),
    "german": ("Das kostet z. B. 3 Euro, d. h. wenig. Mit Dumiru u. a. Danach „Ja. Nein“, sagte er.", ["Das kostet z. B. 3 Euro, d. h. wenig.", "Mit Dumiru u. a.", "Danach „Ja. Nein“, sagte er."]),
    "french": ("C'est vrai, n'est-ce pas ? « Oui. Non », a dit Luc.", ["C'est vrai, n'est-ce pas ?", "« Oui. Non », a dit Luc."]),
    "chinese": ("甲说：“一。二。”三号来了……四号也来了！五。", ["甲说：“一。二。”", "三号来了……", "四号也来了！", "五。"]),
    "japanese": ("田中さんは「一です。二です。」と言いました。三です？四です", ["田中さんは「一です。二です。」と言いました。", "三です？", "四です"]),
    "korean": ("김 씨는 “하나. 둘.”라고 말했습니다. 셋입니다.", ["김 씨는 “하나. 둘.”라고 말했습니다.", "셋입니다."]),
    "thai": ("ห้องสมุดได้เปิด(ดูข้อ 4 ในรายการ) เพราะราคาขึ้น ยามได้พบจดหมาย", ["ห้องสมุดได้เปิด(ดูข้อ 4 ในรายการ) เพราะราคาขึ้น", "ยามได้พบจดหมาย"]),
    "straight quotes": ('"One. Two," he said. Three.', ['"One. Two," he said.', "Three."]),
    "private use": ("ab. Cd.", ["a\ue000b.", "C\ue010d."]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    text, want = CASES[name]
    assert split(spark, [text]) == [want]


def test_null_and_blank(spark):
    assert split(spark, [None, "", "  \n\t", "..."]) == [None, [], [], ["..."]]


def test_pieces_are_the_whole_text(spark):
    texts = [t for t, _ in CASES.values() if "" not in t]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(F.transform(S.pieces(F.col("t")), S.unmask), "").alias("j")).collect()
    assert all(r["t"] == r["j"] for r in rows)


def test_spans_point_at_the_sentences(spark):
    rows = [(k, t) for k, (t, _) in CASES.items() if k != "private use"] + [("emoji", "😀 One. 📌 Two."), ("blank", " "), ("none", None)]
    df = spark.createDataFrame(rows * 2, "source_id string, source_text string").withColumn("kind", F.lit("x"))
    got = {}
    for r in S.sentence_spans(df, "source_id", "source_text").orderBy("source_id", "start_pos").collect():
        got.setdefault(r["source_id"], []).append((r["start_pos"], r["end_pos"]))
    texts = dict(rows)
    for k, spans in got.items():
        want = CASES[k][1] if k in CASES else ["😀 One.", "📌 Two."]
        assert [texts[k][a:b] for a, b in spans] == want
    assert "blank" not in got and "none" not in got


def test_very_long_text(spark):
    text = "A short one here. " * 20_000
    df = spark.createDataFrame([("k", text)], "source_id string, source_text string")
    assert S.sentence_spans(df, "source_id", "source_text").count() == 20_000


def test_empty_table(spark):
    assert S.sentence_spans(spark.createDataFrame([], "source_id string, source_text string"), "source_id", "source_text").count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("k", "a.")], "source_id string, source_text string")
    assert "Python" not in S.sentence_spans(df, "source_id", "source_text")._jdf.queryExecution().executedPlan().toString()


def test_long_quotation_is_one_sentence(spark):
    text = "“" + "We walked on. " * 200 + "Then we slept,” she said. It rained."
    df = spark.createDataFrame([("k", text)], "source_id string, source_text string")
    assert S.sentence_spans(df, "source_id", "source_text").count() == 2


def test_sentences_restore_placeholders_of_the_text_itself(spark):
    text = "One \ue003 here. \ue010Two! “A. B,” she said\ue00a."
    assert split(spark, [text]) == [["One \ue003 here.", "\ue010Two!", "“A. B,” she said\ue00a."]]


@pytest.mark.parametrize("size", [20, 5000])
def test_quotations_and_brackets_of_any_length(spark, size):
    quoted = "“" + "Yes. " * (size // 5) + "No,” she said. It rained."
    bracket = "ห้องสมุดได้เปิด(" + "ดูข้อ 4 " * (size // 8) + ") เพราะราคาขึ้น"
    assert [len(x) for x in split(spark, [quoted, bracket])] == [2, 1]


def test_replays_with_another_text_are_not_mixed(spark):
    rows = [("k", "One. Two. Three."), ("k", "A much longer one here. Short."), ("k", "One. Two. Three.")]
    got = S.sentence_spans(spark.createDataFrame(rows, "source_id string, source_text string"), "source_id", "source_text").orderBy("start_pos").collect()
    assert [(r["start_pos"], r["end_pos"]) for r in got] in ([(0, 4), (5, 9), (10, 16)], [(0, 23), (24, 30)])
