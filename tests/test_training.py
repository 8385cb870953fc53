"""Training rows through a tokenizer, response layouts, span scorers, statistics."""

import pytest
from pyspark.sql import functions as F

from lingloom.functions import text as X
from lingloom.operators import advantage as A
from lingloom.operators import candidates as C
from lingloom.operators import training as T


class Letters:
    def __init__(self, template=False, end=1, turn_end=None):
        self.template, self.end, self.turn_end = template, end, turn_end

    def encode(self, text):
        return [self.turn_end if c == "#" else ord(c) for c in text]

    def render(self, messages, generation):
        if not self.template:
            return None
        return "".join(f"<{m['role'][0]}>{m['content']}#" for m in messages) + ("<a>" if generation else "")


def ask(text):
    return [{"role": "user", "content": text}]


def test_plain_chat_and_closing_token():
    r = T.training_row(Letters(), "ab", "xyz", ask)
    assert r["input_ids"] == [*map(ord, "USER: ab\n\nASSISTANT:"), *map(ord, "xyz"), 1]
    assert r["labels"][: r["prompt_tokens"]] == [T.IGNORED] * r["prompt_tokens"] and r["labels"][-4:] == [*map(ord, "xyz"), 1]


def test_span_of_the_template():
    tok = Letters(True, 1, 7)
    prompt, target = T.target_span(tok, ask("ab"), "xyz")
    assert prompt == tok.encode("<u>ab#<a>") and target == tok.encode("xyz#")
    r = T.training_row(tok, "ab", "xyz", ask)
    assert r["input_ids"][-1] == 7 and r["num_target_tokens"] == 4
    assert T.target_span(Letters(), ask("ab"), "xyz") is None


@pytest.mark.parametrize("most", [1, 2, 5, 20, 40])
def test_budget_is_kept_and_a_target_survives(most):
    r = T.training_row(Letters(), "source " * 20, "target text", ask, T.TrainingConfig(most, 3, 8))
    assert r["full_tokens"] <= most and r["num_target_tokens"] >= 1 and r["labels"].count(T.IGNORED) == r["prompt_tokens"]


def test_source_is_halved_while_nothing_of_the_target_survives():
    class Closing(Letters):
        end = None

        def __init__(self):
            super().__init__(True, None, 7)

        def render(self, messages, generation):
            # this template drops answers to long questions
            if len(messages[0]["content"]) > 10 and len(messages) > 1:
                messages = [messages[0], {"role": "assistant", "content": ""}]
            return super().render(messages, generation)

        def encode(self, text):
            return [] if text == "gone" else super().encode(text)

    r = T.training_row(Closing(), "x" * 64, "yes", ask, T.TrainingConfig(0))
    assert r["source_shrink_steps"] == 6 and r["source_chars"] == 1 and r["source_chars_original"] == 64
    assert T.training_row(Closing(), "x" * 64, " ", ask)["num_target_tokens"] == 0


def test_rows_of_a_table(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, None), (3, "", "c" * 5000)], "k long, s string, t string").withColumn("labels", F.lit("clash"))
    got = {r["k"]: r for r in T.training_rows(df, "k", "s", "t", Letters, ask, T.TrainingConfig(64)).collect()}
    assert got[2]["num_target_tokens"] == 0 and got[3]["full_tokens"] == 64 and len(got[1]["input_ids"]) == got[1]["full_tokens"]
    rows = T.training_rows(df, "k", "s", "t", Letters, ask)
    assert T.with_targets(rows).count() == 2
    with pytest.raises(ValueError):
        T.with_targets(rows.where("k = 2"))
    assert T.with_targets(rows.where("k = 2"), required=False) is None


@pytest.mark.parametrize("most", [8, 96])
def test_piece_budget_like_plain_lists(spark, most):
    import re

    from lingloom.operators import sft as S

    rows = [(i, "ask " * (i % 120), "say it. " * (i * 7 % 90)) for i in range(120)] + [(500, "ask", ""), (501, "", "say"), (502, "ask", " ")]
    got = {r["k"]: r for r in S.tokenize_pairs(spark.createDataFrame(rows, "k int, p string, t string"), F.col("p"), F.col("t"), S.BudgetConfig(most)).collect()}
    for k, p, t in rows:
        prompt, target = re.findall(r"\w+|[^\w\s]", p), re.findall(r"\w+|[^\w\s]", t) if t.strip() else []
        if not target:
            prompt, kept = prompt[:most], []
        else:
            cut = T.TrainingConfig(most)
            prompt, kept = T.within_budget(prompt, target, S.EOS, cut)
        assert got[k]["input"] == prompt + kept and got[k]["prompt_tokens"] == len(prompt) and got[k]["full_tokens"] <= most, k


RESPONSES = [
    ('{"choices": [{"message": {"content": " a "}}]}', "a"),
    ('{"choices": [{"message": {"content": [{"text": "a"}, {"value": "b"}, 3, null]}}]}', "ab3"),
    ('{"choices": [{"message": {"content": null, "output_text": "c"}}]}', "c"),
    ('{"choices": [{"message": {}, "text": "d"}]}', "d"),
    ('{"choices": [{"message": {"content": {"content": [{"text": "e"}]}}}]}', "e"),
    ('{"choices": []}', ""),
    ("nonsense", ""),
    (None, ""),
]


def test_response_layouts(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RESPONSES)], "i int, r string")
    assert [r[1] for r in df.select("i", X.response_text(F.col("r"), 3)).orderBy("i").collect()] == [w for _, w in RESPONSES]


def test_control_characters_are_escaped_like_json(spark):
    import json

    texts = ["plain", "tab\tand\nline", "bell\x07 and \x1f", 'q"\\', "é \x7f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", X.json_string(F.col("t"))).orderBy("i").collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_best_of_repeated_completions(spark):
    s = spark.createDataFrame([("a",)], "source_id string")
    done = spark.createDataFrame([("a", "greedy", "bad", 9.0), ("a", "greedy", "good", 1.0), ("a", "sample", "x", 2.0)], "source_id string, mode string, text string, score double")
    r = C.prefilter_rows(s, done).first()["prefilter"]
    assert (r["greedy_text"], r["score_greedy"], r["improvement"]) == ("good", 1.0, -1.0)


def test_report_of_nothing_is_zeros(spark):
    df = spark.createDataFrame([], "score_first double, reward_first double, score_second double, token_rewards array<double>, spans array<struct<severity:string>>")
    assert set(A.reward_report(df).first().asDict().values()) == {0.0}


def test_batch_moments_equal_those_of_all_tokens(spark):
    import numpy as np

    rows = [("x", [1.0, 2.0]), ("x", []), ("x", [4.0]), ("y", [5.0]), (None, [7.0, 9.0])]
    got = {r["b"]: (r["mean"], r["std"], r["tokens"]) for r in A.batch_moments(spark.createDataFrame(rows, "b string, advantages array<double>"), "b").collect()}
    for b in ("x", "y", None):
        v = [x for k, a in rows if k == b for x in a]
        assert got[b] == pytest.approx((np.mean(v), np.std(v), len(v)))
