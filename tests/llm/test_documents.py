import pytest
from pyspark.sql import functions as F

from lingloom.llm import keyword_spam as K
from lingloom.llm import mixing as M
from lingloom.llm import packing as P
from lingloom.llm.tokens import TokenizerConfig, tokenizer, with_tokens


def docs(spark, rows, kind="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, kind)


def test_token_counts(spark):
    df = docs(spark, [(1, "hello world", "en", "a"), (2, "", None, "a"), (3, None, None, "a")])
    assert [r["n"] for r in with_tokens(df.select("doc_id", "text"), "text", "n").orderBy("doc_id").collect()] == [len(tokenizer(TokenizerConfig()).encode_ordinary("hello world")), 0, 0]


KINDS = "container_kind string, capacity_tokens int"


def test_containers_hold_every_token_once(spark):
    texts = [(i, "word " * (1 + (i * 37) % 700), None, None) for i in range(120)] + [(500, "", None, None), (501, None, None, None), (3, "word " * (1 + 111), None, None)]
    df = docs(spark, texts).withColumn("rest", F.lit("clash"))
    kinds = spark.createDataFrame([("small", 64), ("big", 512), ("none", 0), ("null", None)], KINDS)
    out = P.fill_containers(df, kinds).cache()
    sizes = {r["doc_id"]: r["n"] for r in with_tokens(df.select("doc_id", "text").dropDuplicates(["doc_id"]), "text", "n").collect()}
    for kind, cap in (("small", 64), ("big", 512)):
        rows = out.where(F.col("container_kind") == kind).collect()
        by_doc, by_box = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_token"], r["n_tokens"]))
            by_box[r["container_id"]] = by_box.get(r["container_id"], 0) + r["n_tokens"]
        assert max(by_box.values()) <= cap and set(by_doc) == set(sizes)
        for d, parts in by_doc.items():
            at = 0
            for k, (no, start, n) in enumerate(sorted(parts)):
                assert (no, start) == (k, at)
                at += n
            assert at == sizes[d] and (len(parts) == 1 or sizes[d] > cap)
        assert sum(by_box.values()) / (len(by_box) * cap) > 0.93
    assert out.where("container_kind in ('none', 'null')").count() == 0
    assert P.fill_containers(df.limit(0), kinds).count() == 0


def test_packing_needs_no_more_than_best_fit():
    import random

    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
        placed = P.pack(sizes, 100, 50.0)
        assert len(set(placed)) <= P.tightest(sizes, 100)[1]
        load = {}
        for n, k in zip(sizes, placed):
            load[k] = load.get(k, 0) + n
        assert max(load.values()) <= 100


TARGETS = "mix_id string, source string, target_share double, max_repeats int, budget_share double"


def test_mixing_meets_targets_or_says_so(spark):
    rows = [(i, "alpha beta gamma " * 10, None, "big") for i in range(60)] + [(100 + i, "delta epsilon " * 10, None, "mid") for i in range(20)] + [(200, "zeta " * 5, None, "tiny")] + [(0, "alpha beta gamma " * 10, None, "big")]
    t = spark.createDataFrame([("m", "big", 0.5, 1, 0.2), ("m", "mid", 0.3, 2, 0.2), ("m", "tiny", 0.1, 2, 0.2), ("m", "ghost", 0.1, 5, 0.2)], TARGETS)
    got = M.mix(docs(spark, rows), t)
    report = {r["source"]: r for r in got.report.collect()}
    assert {s for s, r in report.items() if r["exhausted"]} == {"tiny", "ghost"}
    for s in ("big", "mid"):
        assert report[s]["reached"] == pytest.approx(report[s]["wanted"], rel=1e-6)
    assert report["tiny"]["reached"] == pytest.approx(2 * report["tiny"]["available"])
    drawn = M.draw_copies(got)
    assert drawn.agg(F.max("copies")).first()[0] <= 2 and {r["copies"] for r in drawn.where("key = 200").collect()} == {2}


def test_documents_without_source_belong_to_what_they_sound_like(spark):
    rows = [(i, "river boat harbour water sail " * 3, None, "sea") for i in range(30)] + [(100 + i, "oven bread flour yeast dough " * 3, None, "bakery") for i in range(30)]
    rows += [(200, "boat water harbour", None, None), (201, "dough flour oven", None, " "), (202, None, None, None)]
    members = {r["key"]: r["members"] for r in M.memberships(docs(spark, rows), "doc_id", "text", "source", M.MixingConfig()).collect()}
    top = lambda k: max(members[k], key=lambda m: m["share"])["domain"]
    assert top(200) == "sea" and top(201) == "bakery" and members[202] == []
    assert all(abs(sum(m["share"] for m in v) - 1) < 1e-9 for v in members.values() if v)


def test_the_text_may_outvote_a_wrong_label(spark):
    sea, bakery = "river boat harbour water sail anchor mast ", "oven bread flour yeast dough crust salt "
    rows = [(i, sea * (3 + i % 3), None, "sea") for i in range(150)] + [(500 + i, bakery * (3 + i % 3), None, "bakery") for i in range(150)]
    rows += [(1000 + i, bakery * 40, None, "sea") for i in range(6)]  # bakery under the label of the sea
    t = spark.createDataFrame([("m", "sea", 0.5, 1, 0.95), ("m", "bakery", 0.5, 1, 0.95)], TARGETS)
    got = M.mix(docs(spark, rows), t)
    sizes = {r["key"]: r["n"] for r in got.rates.collect()}
    true_bakery = sum(n for k, n in sizes.items() if k >= 500)
    labelled_sea = sum(n for k, n in sizes.items() if k < 500 or k >= 1000)
    report = {r["source"]: r for r in got.report.collect()}
    assert report["bakery"]["available"] == pytest.approx(true_bakery, rel=0.02)
    # by the labels the sea could serve its half; by what the texts are it cannot
    assert labelled_sea > report["sea"]["wanted"] > report["sea"]["reached"] and report["sea"]["exhausted"] and not report["bakery"]["exhausted"]


def test_text_that_says_nothing_leaves_the_label(spark):
    rows = [(i, "any words will do here " * (1 + i % 5), None, ["a", "b", "c"][i % 3]) for i in range(300)]
    got = {r["key"]: r["members"] for r in M.memberships(docs(spark, rows), "doc_id", "text", "source").collect()}
    assert all([(m["domain"], m["share"]) for m in got[i]] == [(["a", "b", "c"][i % 3], 1.0)] for i in range(300))


def test_drawn_shares_are_those_of_the_draw(spark):
    rows = [(i, "alpha beta gamma " * 10, None, "big") for i in range(200)] + [(500 + i, "delta epsilon " * 10, None, "mid") for i in range(60)]
    t = spark.createDataFrame([("m", "big", 0.5, 1, 0.3), ("m", "mid", 0.5, 3, 0.3)], TARGETS)
    got = M.mix(docs(spark, rows), t)
    drawn = M.draw_copies(got).collect()
    report = {r["source"]: r for r in M.drawn_report(got).collect()}
    for source, mine in (("big", lambda k: k < 500), ("mid", lambda k: k >= 500)):
        assert report[source]["drawn"] == sum(r["n"] * r["copies"] for r in drawn if mine(r["key"]))
        assert report[source]["drawn"] == pytest.approx(report[source]["reached"], rel=0.25)
    assert sum(r["drawn_share"] for r in report.values()) == pytest.approx(1.0)


def test_rates_are_those_of_least_squares_when_domains_overlap():
    import numpy as np

    shares = np.array([[1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    plan = M.Plan(["m"], ["a", "b"], np.array([[30.0, 40.0]]), np.array([[3.0, 2.0]]))
    assert M.caps_of(shares, plan)[:, 0].tolist() == [3.0, 2.0, 2.0, 0.0]
    assert M.rates_of(shares, plan, [np.array([[9.0, -1.0]])])[:, 0].tolist() == [3.0, 2.0, 0.0, 0.0]
    assert M.members_of(np.array([0.5, 0.3, 0.2]), 16) == [(0, 8), (1, 5), (2, 3)]


def test_mixing_nothing(spark):
    t = spark.createDataFrame([("m", "big", 1.0, 1, 0.2)], TARGETS)
    report = M.mix(docs(spark, []), t).report.first()
    assert report["reached"] == 0.0 and not report["exhausted"]


PROSE = "The village school painted the long wall blue because the old plan had failed. A retired sailor checked the new ticket machine near the harbour, and nobody asked why. "
CASES = {
    "keywords": ("copper lamp, copper lamp, sale, copper lamp, best copper lamp, cheap copper lamp, copper lamp shop, copper lamp, copper lamp", True),
    "links": ("\n".join(f"[lamp {i}](http://a{i}.example/b) - http://c.example/{i}" for i in range(12)), True),
    "tags": (" | ".join(f"buy garden chair B-{i}" for i in range(30)), True),
    "hashtags": ("\n".join(f"#garden_chair{i}" for i in range(20)), True),
    "prose": (PROSE * 5, False),
    "few links": (PROSE * 5 + "\nwww.a.example/1.html", False),
    "list": ("\n".join(f"- {s}" for s in PROSE.split(". ") * 4), False),
    "refrain": ((PROSE + "So we go on and on, as we did before.\n") * 6, False),
    "mixed": (PROSE + "\n" + "copper lamp. Sale copper lamp. Cheap lamp! " * 12, True),
    "chinese tags": ("最好 冬季夹克. 商城 冬季夹克. 网购 冬季夹克! 便宜 电动自行车. " * 5, True),
    "chinese prose": ("由于机器的声音太大，村里的学校在北部城区卖掉了最后一盏铜灯。但是暴风雨过后乐团公布了道路名称的清单。" * 3, False),
}


# Prose is learned from the data, so there has to be some: sentences in any order, some as lists, some with a refrain.
SENTENCES = [x.strip() + "." for x in (PROSE + "The night guard moved the heavy piano because the river was too high. In short, the library sold the last lamp to an old teacher. So we go on and on, as we did before. The baker cooked a soup of wild mushrooms while the children were watching. Our neighbour painted the wooden bridge at the edge of the forest. The museum lost the key to the archive after the storm. A young engineer opened the new reading room, although nobody had asked for it. We planted forty apple trees near the harbour. ").split(". ") if x.strip()]
HAN_SENTENCES = [x + "。" for x in "由于机器的声音太大，村里的学校在北部城区卖掉了最后一盏铜灯。但是暴风雨过后乐团公布了道路名称的清单。图书馆的老师在河边种下了四十棵苹果树。因为价格上涨了，邻居把长墙刷成了蓝色。面包师在孩子们的注视下煮了一锅野生蘑菇汤。博物馆在暴风雨过后弄丢了档案室的钥匙".split("。")]


def any_prose(i, sentences):
    import random

    rng = random.Random(i)
    chosen = [rng.choice(sentences) for _ in range(3 + i % 9)]
    return "\n".join(f"- {x}" for x in chosen) if i % 4 == 0 else "\n".join(chosen) if i % 4 == 1 else " ".join(chosen)


def test_keyword_pages(spark):
    rows = [(i, any_prose(i, SENTENCES), "en", "a") for i in range(200)] + [(500 + i, any_prose(i, HAN_SENTENCES), "zh", "a") for i in range(60)]
    rows += [(1000 + i, t, None if i % 2 else "en", "a") for i, (t, _) in enumerate(CASES.values())]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "a"), (1000, CASES["keywords"][0], "en", "a")]
    got = {r["page"] for r in K.keyword_pages(docs(spark, rows).withColumn("n", F.lit("clash"))).collect()}
    assert got == {1000 + i for i, (_, spam) in enumerate(CASES.values()) if spam}
    assert K.keyword_pages(docs(spark, [])).count() == 0


def test_copies_do_not_make_keywords_prose(spark):
    rows = [(i, prose_page(i), "en", "a") for i in range(120)] + [(1000 + i, keyword_page(3), "en", "a") for i in range(60)]
    assert {r["page"] for r in K.keyword_pages(docs(spark, rows)).collect()} == {1000 + i for i in range(60)}


def test_long_and_odd_pages(spark):
    rows = [(i, prose_page(i), "en", "a") for i in range(80)] + [(1000, prose_page(7, 4000), "en", "a"), (1001, keyword_page(5, 3000), "no code", None), (1002, "!" * 5000, None, None), (1003, "😀\ue000\x00", "en", ""), (1004, "word", "en", "a"), (None, keyword_page(9), "en", "a")]
    got = {r["page"] for r in K.keyword_pages(docs(spark, rows + rows).withColumn("ids", F.lit("clash"))).collect()}
    assert {1001, None} <= got and not got & {*range(80), 1000}
    assert got - {1001, None} <= {1002, 1003, 1004}  # a few tokens that prose never has side by side count as no prose


def test_curve_of_a_page_is_its_least_squares_line(spark):
    import numpy as np

    text = "a a a a b b c d d e f f f g"
    tokens = K.tokenized(spark.createDataFrame([(1, "en", text)], "page long, lang string, text string"))
    copies = np.zeros(1 << 20, dtype=np.int64)
    everything = lambda c: np.ones(len(c.n), dtype=bool)
    found = K.measured(tokens, K.learn(tokens, copies, K.SpamConfig(), everything), K.SpamConfig(), everything)
    got = K.rank_frequency(K.with_divergence(found, K.Baselines())).first()
    x, y = np.log(np.arange(1, 8)), np.log([4, 3, 2, 2, 1, 1, 1])
    slope, at = np.polyfit(x, y, 1)
    assert got["slope"] == pytest.approx(slope) and got["residual"] == pytest.approx(np.sqrt(np.mean((y - slope * x - at) ** 2)))
    assert got["n"] == 14 and got["divergence"] is None


WORDS = "school wall plan sailor ticket machine harbour village lamp chair garden road storm market bridge letter window river teacher engine bakery coat winter morning".split()
SMALL = "the of and a to in was for that with on as".split()


def prose_page(i, sentences=12):
    import random

    rng = random.Random(i)
    one = lambda: " ".join(w for _ in range(6) for w in (rng.choice(SMALL), rng.choice(WORDS))).capitalize() + "."
    return " ".join(one() for _ in range(sentences))


def keyword_page(i, times=18):
    import random

    rng = random.Random(i)
    a, b = rng.sample(WORDS, 2)
    return ", ".join(f"{rng.choice(['cheap', 'best', 'new', 'buy'])} {a} {b} {rng.choice(['sale', 'shop', 'price', 'online'])}" for _ in range(times * 2))


@pytest.mark.parametrize("share", [0.05, 0.4, 0.9])
def test_keyword_pages_at_any_share_of_their_class(spark, share):
    n = round(200 * share)
    rows = [(i, keyword_page(i), "en", "a") for i in range(n)] + [(1000 + i, prose_page(i), "en", "a") for i in range(200 - n)]
    assert {r["page"] for r in K.keyword_pages(docs(spark, rows)).collect()} == set(range(n))


def test_keyword_page_alone_in_its_length_class(spark):
    rows = [(i, prose_page(i), "en", "a") for i in range(60)] + [(1000, keyword_page(1, 400), "en", "a"), (1001, keyword_page(2), "de", "a"), (1002, prose_page(1, 400), "de", "a")]
    assert {r["page"] for r in K.keyword_pages(docs(spark, rows)).collect()} == {1000, 1001}


def test_keyword_pages_of_languages_without_a_profile_and_of_other_spellings(spark):
    rows = [(i, prose_page(i), ["en", "EN-us", "eng", " en "][i % 4], "a") for i in range(60)] + [(500 + i, prose_page(i), "fr", "a") for i in range(40)] + [(1000 + i, keyword_page(i), "fr", "a") for i in range(10)]
    df = docs(spark, rows)
    assert df.select(K.language_hash(F.col("lang"))).distinct().count() == 2
    assert {r["page"] for r in K.keyword_pages(df).collect()} == {1000 + i for i in range(10)}
