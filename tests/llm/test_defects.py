import numpy as np
from pyspark.sql import functions as F

from lingloom.llm import defects as D
from lingloom.llm import language as L

EN = ["The library opened a new reading room.", "The gardener planted forty apple trees near the harbour.", "Our neighbour sold the last copper lamp.", "The museum lost the key to the archive."]
DE = ["Die Bibliothek eröffnete einen neuen Lesesaal.", "Der Gärtner pflanzte vierzig Apfelbäume in der Nähe des Hafens.", "Unser Nachbar verkaufte die letzte Kupferlampe.", "Das Museum verlor den Schlüssel zum Archiv."]
FR = "La bibliothèque a ouvert une nouvelle salle de lecture dans la ville, et le musée est sur la place."


def table(spark):
    rows = []
    for i in range(400):
        k = [i % 4, (i // 4) % 4, (i // 16) % 4]
        rows.append((i, "en->de", " ".join(EN[j] for j in k), " ".join(DE[j] for j in k)))
    special = {
        "empty": [None, "", " ​", "...", "N/A", "[ ]"],
        "copy": [rows[0][2], rows[1][2].upper(), '"' + rows[2][2] + '"', rows[3][2].rsplit(" The", 1)[0]],
        "refusal": ["I'm sorry, but I can't help with this request.", "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "This sentence falls outside what I may process."],
        "wrong_language": [FR, FR + " " + FR],
        "truncated": [rows[4][3][:-20], rows[5][3][: len(rows[5][3]) // 2] + "-", rows[6][3][:70] + " ..."],
    }
    want = {}
    at = 1000
    for d, answers in special.items():
        for j, a in enumerate(answers):
            source = rows[{"copy": j, "truncated": 4 + j}.get(d, 9)][2]
            rows.append((at, "en->de", source, a))
            want[at] = d
            at += 1
    rows.append((5000, "en->de", rows[7][2], rows[7][3][:-1]))  # complete, only the last mark is missing
    rows.append((5001, "en->de", "“I am sorry, I cannot help you,” said Ann. " + EN[0], "„Es tut mir leid, ich kann Ihnen nicht helfen“, sagte Ann. " + DE[0]))
    return spark.createDataFrame(rows + rows[:20], "row_id long, pair_id string, source_text string, target_text string"), want


def labelled(spark, final):
    return D.label(D.votes_of_pairs(final, L.seed_words()))


def test_defects(spark):
    final, want = table(spark)
    got = {r["row_id"]: r["defect"] for r in D.one_defect(labelled(spark, final.withColumn("defect", F.lit("clash")))).collect()}
    assert got == want


def test_no_pairs(spark):
    final, _ = table(spark)
    assert labelled(spark, final.limit(0)).count() == 0


def test_label_model_recovers_a_planted_defect():
    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.05
    votes = np.stack([np.where(rng.random(5000) < 0.1, -1, np.where(rng.random(5000) < np.where(truth, 0.85, 0.03), 1, 0)) for _ in range(4)], axis=1)
    model = D.fit_label_model(votes, np.ones(5000))
    p = model.posterior(votes) > 0.5
    assert abs(model.share - 0.05) < 0.02 and (p & truth).sum() / truth.sum() > 0.9 and (p & truth).sum() / p.sum() > 0.85
    assert 0.5 <= D.choose_cutoff(model, votes, np.ones(5000), 0.5) <= 1


def test_quoted_refusals_are_none():
    assert not D.declines(D.QUOTED.sub(" ", "“I am sorry, I cannot help you with that,” said Ann."))
    assert D.declines("죄송하지만 이 글은 번역해 드릴 수 없습니다.") and not D.declines("고양이가 잡니다.")


def test_hostile_rows_have_defined_labels(spark):
    final, want = table(spark)
    odd = [(9000, None, None, None), (9001, "en->de", None, "Der Hund."), (9002, "", "x", "y"), (9003, "en->de", "The dog is here. " * 3000, "Der Hund ist hier und nicht dort. " * 3000), (9004, "en->xx", EN[0], DE[0]), (None, "en->de", EN[0], DE[0])]
    df = final.unionByName(spark.createDataFrame(odd + odd, final.schema)).withColumn("votes", F.lit("clash")).withColumn("source", F.lit(1))
    got = {r["row_id"]: r["defect"] for r in D.one_defect(labelled(spark, df)).collect()}
    assert got[9000] == "empty" and 9003 not in got and 9004 not in got
    assert {k: v for k, v in got.items() if k is not None and k < 9000} == want


def test_wrong_language_gives_way_to_copy_and_refusal(spark):
    rows = [(1, "wrong_language", 0.99), (1, "refusal", 0.7), (2, "wrong_language", 0.9), (2, "truncated", 0.95), (3, "copy", 0.8), (3, "truncated", 0.8)]
    got = {r["row_id"]: r["defect"] for r in D.one_defect(spark.createDataFrame(rows, "row_id long, defect string, posterior double")).collect()}
    assert got == {1: "refusal", 2: "truncated", 3: "copy"}


def test_planted_defects_are_what_they_say():
    sample = [("en->de", "de", " ".join(EN[:2]), " ".join(DE[:2])), ("en->fr", "fr", EN[1], FR), ("en->de", "de", None, DE[0])]
    got = D.planted(sample)
    assert {d for d, *_ in got} == {"copy", "empty", "truncated", "wrong_language"}
    for d, _, want, source, target in got:
        assert d != "copy" or target == source
        assert d != "truncated" or not target.endswith((".", "!"))
        assert d != "wrong_language" or (want == "fr") == (target != FR)


def test_words_and_cutoffs_come_from_all_pairs(spark, monkeypatch):
    final, _ = table(spark)
    final = final.unionByName(final.withColumn("row_id", F.col("row_id") + 10_000))
    asked = []
    learn = L.fit_words
    monkeypatch.setattr(L, "fit_words", lambda records, config=L.LanguageConfig(): asked.append(config.fit_rows) or learn(records, config))
    votes = D.votes_of_pairs(final)
    assert asked == [None]
    pairs = final.dropDuplicates(["row_id"])
    n = {(r["defect"], r["positive"]): r["n"] for r in votes.cases.groupBy("defect", "positive").agg(F.sum("n").alias("n")).collect()}
    full = pairs.where("source_text != '' and target_text != ''").count()
    assert full > 800 and n["copy", True] == n["empty", True] == full
    assert n["refusal", False] == sum(n[d, True] for d in ("copy", "empty", "truncated", "wrong_language") if (d, True) in n)


def test_words_are_counted_in_every_record(spark):
    rows = [("t", str(i), "der Hund und die Katze sind nicht hier" + (" Kupferkessel" if i % 5 < 2 else ""), "de") for i in range(1500)]
    words = L.fit_words(spark.createDataFrame(rows, "origin string, rec_key string, text string, declared string"), L.LanguageConfig(fit_rows=None))
    other = next(k for k, c in enumerate(L.LANGUAGES) if c != "de")
    assert np.isclose(words["kupferkessel"][other], np.log(0.5 / 100 / (600 / 1500)), atol=1e-9)
