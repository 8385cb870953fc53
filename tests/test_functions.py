import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lingloom.functions import lang, tokens
from lingloom.functions import text as X


def col(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize(spark):
    assert col(spark, ["  a \t b　c\n", "", None, "\x1cx\x1f"], X.normalize_text) == ["a b c", "", None, "x"]


def test_length_is_words_plus_half_the_marks(spark):
    assert col(spark, ["", "a b c", "a, b! c. d?", "한국어 문장입니다."], X.approx_token_length) == [1, 4, 6, 3]


def test_noise(spark):
    lines = ["", " ", "https://a.b/c", "www.a.b", "see www.a.b", "<a><b><c>", "<a><b>", "def f", "définir", "};}", "x" * 400 + " class "]
    assert col(spark, lines, X.is_noise) == [True, True, True, True, False, True, True, True, False, True, False]


def test_jaccard(spark):
    rows = spark.createDataFrame([("A b", "b c"), ("", "x"), ("x", "X")], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(X.jaccard_overlap(F.col("a"), F.col("b"))).collect()] == [round(1 / 3, 6), 0.0, 1.0]


def test_stable_hash_is_the_hash_of_canonical_json(spark):
    values = ["doc1", 'q"uote', "zeile\n2", "한", "back\\slash"]
    want = [hashlib.sha256(json.dumps({"key": v}, ensure_ascii=False, sort_keys=True).encode()).hexdigest() for v in values]
    assert col(spark, values, X.stable_hash) == want


def test_split_lines_like_the_language_does(spark):
    values = ["a\r\nb\rc\n\nd", "a\x0bb\x1cc d", "", "one"]
    got = col(spark, values, lambda v: F.filter(X.split_lines(v), lambda x: x != ""))
    assert got == [[x for x in v.splitlines() if x] for v in values]


def test_restore_truncate_pick(spark):
    assert col(spark, ["a\\nb", "a\\r\\nb\\r"], X.restore_newlines) == ["a\nb", "a\nb\n"]
    assert col(spark, ["abcdef", "abc"], lambda v: X.truncate_for_log(v, 3)) == ["abc ... [truncated 3 chars]", "abc"]
    assert col(spark, [" x ", " ", None], lambda v: X.pick_text(v, F.lit("d"))) == ["x", "d", "d"]


def test_heuristic_score_bounds(spark):
    rows = spark.createDataFrame([("abc", ""), ("abc", "abc"), ("abc", "xyz"), ("a", "b " * 50)], "s string, h string")
    assert [r[0] for r in rows.select(X.heuristic_score(F.col("s"), F.col("h"))).collect()] == [25.0, 15.0, 5.0, 25.0]


def test_language_codes_and_names(spark):
    assert col(spark, ["ENG", " ko_KR ", "zho", "xx"], lang.normalize_code) == ["en", "ko-kr", "zh", "xx"]
    assert col(spark, ["ko", "ko-KR", "PT_br", "qq"], lang.language_name) == ["Korean", "Korean", "Portuguese", "qq"]
    assert lang.ordered_distinct(["eng", "ko", "en", "", "KO"]) == ["en", "ko"]


def test_offsets(spark):
    assert [tuple(x) for x in col(spark, [["Hel", "lo", "!"]], tokens.piece_offsets, "array<string>")[0]] == [(0, 3), (3, 5), (5, 6)]
    assert col(spark, [[]], tokens.piece_offsets, "array<string>") == [[]]


SPANS = "array<struct<start:int,end:int,severity:string,confidence:double>>"
OFFSETS = [(0, 5), (5, 6), (6, 11)]


def rewards(spark, spans, **kw):
    rows = spark.createDataFrame([(OFFSETS, spans)], f"o array<struct<start:int,end:int>>, s {SPANS}")
    return rows.select(tokens.span_token_rewards(F.col("o"), F.col("s"), **kw)).first()[0]


def test_span_rewards(spark):
    assert rewards(spark, [(6, 11, "MAJOR", None)]) == [0.0, 0.0, -5.0]
    both = [(0, 11, "minor", 0.5), (6, 7, "MAJOR", 0.5), (3, 3, "MAJOR", None), (0, 11, "unknown", None)]
    assert rewards(spark, both) == [-1.0, -1.0, -6.0]
    assert rewards(spark, both, policy="majority_overlap") == [-1.0, -1.0, -1.0]
    assert rewards(spark, both, combine_policy="min") == [-1.0, -1.0, -5.0]
    assert rewards(spark, both, combine_policy="max") == [-1.0, -1.0, -1.0]
    assert rewards(spark, both, use_confidence=True) == [-0.5, -0.5, -3.0]
    assert rewards(spark, []) == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        rewards(spark, [], policy="none")


def test_array_helpers(spark):
    rows = spark.createDataFrame([([1, 2, 9, 3], [1, 2, 4])], "a array<int>, b array<int>")
    got = rows.select(tokens.trim_completion(F.col("a"), [9, 0]), tokens.common_prefix_length(F.col("a"), F.col("b")), *tokens.align(F.col("a"), F.col("b"))).first()
    assert list(got) == [[1, 2], 2, [1, 2, 9], [1, 2, 4]]


def test_combine_wants_equal_lengths(spark):
    rows = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="length mismatch"):
        rows.select(tokens.combine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("p,t,most", [(10, 5, 20), (10, 5, 15), (50, 5, 40), (50, 60, 40), (3, 0, 2), (100, 1, 40)])
def test_budget(spark, p, t, most):
    rows = spark.createDataFrame([(["p"] * p, ["t"] * t)], "p array<string>, t array<string>")
    b = rows.select(tokens.budget(F.col("p"), F.col("t"), most, "<e>").alias("b")).first()["b"]
    assert len(b["input"]) == len(b["labels"]) == b["prompt_tokens"] + b["target_tokens"] <= most
    assert b["labels"][: b["prompt_tokens"]] == ["-100"] * b["prompt_tokens"]
    if t:
        assert b["input"][-1] == "<e>" and b["labels"][-1] == "<e>"
    else:
        assert b["target_tokens"] == 0
