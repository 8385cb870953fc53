import os

import pytest
from pyspark.sql import functions as F

from lingloom.llm import language as L

SCHEMA = "origin string, rec_key string, text string, declared string, host string, suffix string"
EN = "The cat sat on the mat because it was warm and the dog was not there. "
DE = "Der Hund ist nicht auf der Straße, weil es regnet und die Katze auch da ist. "
KO = "고양이가 방에서 자고 있습니다. "


def run(spark, rows):
    df = spark.createDataFrame([("o", k, t, d, h, None) for k, t, d, h in rows], SCHEMA)
    return {r["rec_key"]: r for r in L.identify(df, words=L.seed_words()).collect()}, df


def test_runs(spark):
    rows = [("a", EN, "en", "h"), ("b", EN + DE, "en", "h"), ("c", KO + EN, None, None), ("d", DE, "en", "h"), ("e", None, "en", "h"), ("f", "N/A", None, "h"), ("g", "12 34", "xx", "h"), ("h", "", "en", "h")]
    got, _ = run(spark, rows)
    langs = {k: [x["lang"] for x in r["runs"]] for k, r in got.items()}
    assert langs == {"a": ["en"], "b": ["en", "de"], "c": ["ko", "en"], "d": ["de"], "e": [], "f": [], "g": [], "h": []}
    assert all(0 < x["confidence"] <= 1 for r in got.values() for x in r["runs"])


def test_mislabelled_and_mixed_are_found(spark):
    rows = [("a", EN, "EN_us", "h"), ("b", EN + DE, "en", "h"), ("d", DE, "eng", "h"), ("m", EN, " ", "h"), ("u", EN, "und", "h"), ("e", "-", None, "h")]
    _, df = run(spark, rows)
    found = L.mislabelled(L.identify(df.union(df), words=L.seed_words())).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["run_no"]):
        got.setdefault(r["rec_key"], []).append(r["lang"])
    assert got == {"b": ["en", "de"], "d": ["de"], "m": ["en"], "u": ["en"]}


def test_names_and_quoted_terms_change_nothing(spark):
    got, _ = run(spark, [("a", EN + "Filed by Tasivewa Vewagaba (4587). " + "The sign “Straße nicht” is on the wall. " + EN, "en", "h")])
    assert [x["lang"] for x in got["a"]["runs"]] == ["en"]


def test_codes(spark):
    df = spark.createDataFrame([(c,) for c in ["EN", " de-AT", "ko_KR", "jpn", "", None, "und", "N/A", "xx", "zh-Hans", "unknown"]], "c string")
    assert [r[0] for r in df.select(L.normal_code(F.col("c"))).collect()] == ["en", "de", "ko", "ja", None, None, None, None, None, "zh", None]


def test_address_suffix(spark):
    df = spark.createDataFrame([("https://www.a.de/x",), ("b.co.jp",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(L.address_suffix(F.col("u"))).collect()] == ["de", "jp", None, None]


def test_priors_are_smoothed_towards_parents(spark):
    rows = [("o", str(i), "x", "de", "big", None) for i in range(200)] + [("o", "s", "x", "fr", "small", None)]
    priors, base = L.host_priors(spark.createDataFrame(rows, SCHEMA))
    by = {r["host"]: r["prior"] for r in priors.collect()}
    assert by["big"][L.INDEX["de"]] > by["small"][L.INDEX["de"]] > by["small"][L.INDEX["pl"]]


def test_own_label_is_no_evidence_of_its_host(spark):
    lone = [("o", "a", "Tasivewa is here", "fr", "only", None)] + [("o", str(i), EN, "en", f"h{i}", None) for i in range(50)]
    priors, base = L.host_priors(spark.createDataFrame(lone, SCHEMA))
    prior = {r["host"]: r["prior"] for r in priors.collect()}["only"]
    import numpy as np

    known = np.array([base[c] for c in L.LANGUAGES])
    plain = L.decode_batch([b""], [prior], ["fr"], known, L.LanguageConfig())
    assert plain.to_pylist() == [[]] and abs(prior[-1] - 21) < 1e-6


def test_host_and_suffix_decide_where_the_text_does_not(spark):
    # words of Danish-like spelling that several languages share: the site and the suffix speak
    rows = [("o", str(i), DE, "de", "site", "de") for i in range(60)] + [("o", f"e{i}", EN, "en", "other", "uk") for i in range(60)]
    rows += [("o", "x", "Die Panorama. Die.", None, "site", "de"), ("o", "y", "in an in an", None, "new", "de"), ("o", "z", "in an in an", None, "new2", "uk")]
    got = {r["rec_key"]: [x["lang"] for x in r["runs"]] for r in L.identify(spark.createDataFrame(rows, SCHEMA), words=L.seed_words()).collect()}
    assert got["x"] == ["de"] and got["y"] == ["de"] and got["z"] == ["en"]


def test_heavy_hosts_are_split(spark):
    rows = [("o", str(i), EN if i % 2 else DE, None if i % 5 else "en", "hot", None) for i in range(300)] + [("o", "n", EN, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = {r["rec_key"]: r["runs"] for r in L.identify(df, words=L.seed_words()).collect()}
    assert plain == {r["rec_key"]: r["runs"] for r in L.identify(df, L.LanguageConfig(heavy_rows=20), L.seed_words()).collect()} and len(plain) == 301


@pytest.mark.parametrize("n", [1, 60])
def test_quoted_terms_of_any_length(spark, n):
    got, _ = run(spark, [("a", EN + "The sign “" + "nicht auf der Straße " * n + "ist” is on the wall. " + EN, "en", "h")])
    assert [x["lang"] for x in got["a"]["runs"]] == ["en"]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("prior", F.lit(1)).withColumn("runs", F.lit("x"))
    assert L.mislabelled(L.identify(df, words=L.seed_words())).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_held_out_accuracy(spark):
    """Words learned from half of the labelled records, judged on the other half, where labels are mostly right."""
    r = L.corpus_records(spark, "/root/testdata/sf0.01").where("origin = 'sampled_sources'")
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    words = L.fit_words(r.where(half == 0))
    got = L.identify(r.where(half == 1), words=words).where("size(runs) = 1 AND declared is not null").select(F.col("declared") == F.col("runs")[0]["lang"]).collect()
    assert sum(x[0] for x in got) / len(got) > 0.95
