import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingloom.llm import near_duplicates as N


def grams(t):
    t = N.normal_text(t)
    return {t[i : i + 5] for i in range(len(t) - 4)}


def brute(rows, least=150, t=0.7):
    kept = sorted({k: x for k, x in rows if x is not None and len(x) >= least}.items())
    g = {k: grams(x) for k, x in kept}
    return {(a, b) for i, (a, _) in enumerate(kept) for b, _ in kept[i + 1 :] if g[a] | g[b] and len(g[a] & g[b]) / len(g[a] | g[b]) >= t}


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["river", "stone", "garden", "paper", "window", "teacher", "lamp", "bridge", "village", "harbour", "질문", "書庫", "école"]
    rows = []
    for k in range(n):
        base = [rng.choice(words) + rng.choice(["", "s", str(rng.randint(0, 99))]) for _ in range(40)]
        rows.append((f"a{k:03}", " ".join(base)))
        for j in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(0, 9)):
                other[rng.randrange(len(other))] = rng.choice(words)
            if rng.random() < 0.4:
                other = other[20:] + other[:20]
            rows.append((f"b{k:03}{j}", ("  " if j else "") + " ".join(other).upper()))
    return rows


@pytest.mark.parametrize("block", [4, 20_000])
def test_like_brute_force(spark, block):
    rows = made(1) + [("copy1", "The same text again and again. " * 8), ("copy2", "the same  text again and AGAIN. " * 8), ("short", "x" * 20), ("null", None), ("dup", "y" * 200), ("dup", "y" * 200)]
    df = spark.createDataFrame(rows, "source_id string, source_text string").withColumn("rep", F.lit("clash"))
    found = N.near_duplicates(df, config=N.NearDuplicateConfig(block=block, slots=1 << 12))
    got = {(r["a"], r["b"]) for r in N.expand(found).collect()}
    assert got == brute(rows)
    classes = {r["key"]: r for r in N.class_links(found).collect()}
    assert classes["copy1"]["rep"] == classes["copy2"]["rep"] == "copy1" and "short" not in classes


def test_bitmaps_fold():
    h = N.gram_hashes("".join(random.Random(2).choice("abcdefgh ") for _ in range(900)), 5)
    big, small = N.parity(h, 2048)[None, :], N.parity(h, 512)[None, :]
    assert (N.fold(big, 512) == small).all()


def test_tree_walk_equals_plain_similarity():
    rng = random.Random(4)
    for _ in range(200):
        of = sorted(rng.sample(range(40), rng.randint(1, 25)))
        sets = [sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in range(12)]
        got = N.walk_tree(of, sets, 0.5)
        for s, g in zip(sets, got):
            j = len(set(of) & set(s)) / len(set(of) | set(s))
            assert (g is None and j < 0.5) or (g is not None and abs(g - j) < 1e-12)


def test_groups_lose_no_pair():
    rng = np.random.default_rng(5)
    t = 0.7
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 50))).astype(np.uint64) for _ in range(40)]
    sets += [s[:-2] for s in sets[:20]]
    hashed = [N._slot(s, 64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    group, depth, n, ident, maps = [], [], [], [], []
    for i, s in enumerate(sets):
        for d, e in enumerate(s):
            group.append(int(e)), depth.append(d), n.append(len(s)), ident.append(i), maps.append(N.parity(s * np.uint64(0x9E3779B97F4A7C15), 512).tobytes())
    order = np.argsort(group, kind="stable")
    arrays = [np.array(x)[order] for x in (group, depth, n, ident)]
    pairs = set()
    for a, b in N.pairs_in_groups(*arrays, [maps[k] for k in order], t, 1000):
        pairs |= set(zip(a.tolist(), b.tolist()))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if len(x & y) / len(x | y) >= t:
                assert (i, j) in pairs
    assert hashed


def test_empty_and_hostile_input(spark):
    df = spark.createDataFrame([], "source_id string, source_text string")
    assert N.expand(N.near_duplicates(df)).count() == 0
    rows = [("a", " " * 300), ("b", "\n" * 300), ("c", "x" * 200_000), ("d", "x" * 199_999 + "y")]
    got = {(r["a"], r["b"]) for r in N.expand(N.near_duplicates(spark.createDataFrame(rows, "source_id string, source_text string"))).collect()}
    assert ("c", "d") not in got and ("a", "b") in got  # c has one n-gram, d five; two blank texts are copies


def test_like_brute_force_when_a_task_cannot_hold_all_bitmaps(spark):
    rows = made(6, 40) + [("long", " ".join(f"word{k}" for k in range(500)))]
    df = spark.createDataFrame(rows, "source_id string, source_text string")
    found = N.near_duplicates(df, config=N.NearDuplicateConfig(part_entries=len(rows) // 3, texts_at_once=7))
    assert {(r["a"], r["b"]) for r in N.expand(found).collect()} == brute(rows)


def test_index_does_not_grow_with_its_parts(spark):
    rows = [(k, N.normal_text(x)) for k, (_, x) in enumerate(made(7, 300))]
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    config = N.NearDuplicateConfig()
    counts = spark.sparkContext.broadcast(N.frequencies(texts, config))

    def size(parts):
        index = N.tree_prefixes(texts, counts, {}, parts, config)
        return index.select(sum(F.octet_length(c) for c, kind in index.dtypes if kind == "binary").alias("n")).agg(F.sum("n")).first()[0] / len(rows)

    one, many = size(1), size(50)
    assert many < 2 * one
    assert one < 450  # bytes a text


def test_postings_are_packed_without_loss():
    rng = np.random.default_rng(8)
    for deepest in (50, 70_000):
        key = np.sort(rng.integers(0, 1 << 32, 3000, dtype=np.uint32) // 7)
        text, depth, ident = rng.integers(0, 400, 3000), rng.integers(0, deepest, 3000).astype(np.int32), np.cumsum(rng.integers(1, 1 << 40, 400))
        got = N.unpacked_postings(*N.packed_postings(key, text, depth, ident))
        assert all((x == y).all() for x, y in zip(got, (key, depth, ident[text])))
