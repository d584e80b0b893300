import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm.neardup import Sketches, likeness, near_pairs, width
from turnloom.llm.queries import _short_texts


def grams(t):
    t = "".join(c for c in (t or "").lower() if c.isalnum())
    return {t[k : k + 3] for k in range(len(t) - 2)}


def brute(rows, t=0.6):
    out, sets = set(), [(s, i, grams(x)) for s, i, x in {tuple(r) for r in rows}]
    for k, (s, i, a) in enumerate(sets):
        for s2, j, b in sets[k + 1 :]:
            if s == s2 and i != j and a and b and len(a & b) >= t * len(a | b) - 1e-12:
                out.add((s, min(i, j), max(i, j)))
    return out


def test_against_brute_force_on_the_tables(spark, sf):
    docs = _short_texts(spark, sf)
    got = [tuple(r) for r in near_pairs(docs).collect()]
    want = brute([(r.src, r.id, r.text) for r in docs.where("text is not null").collect()])
    assert len(got) == len(set(got)) and set(got) == want


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, i = [], 0
    for g in range(40):
        base = [word() for _ in range(rng.choice([5, 15, 40, 90]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 4)):
                w[rng.randrange(len(w))] = word()
            rng.random() < 0.3 and w.insert(0, w.pop())
            i += 1
            rows.append(("s" if g % 2 else "t", i, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [4096, 3])
def test_edits_and_large_blocks(spark, edited, tile):
    """With tiles of three rows nearly every block is a large one and goes through the pairs of tiles."""
    df = spark.createDataFrame(edited, "src string, id bigint, text string")
    got, want = {tuple(r) for r in near_pairs(df, tile=tile).collect()}, brute(edited)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_a_hot_block(spark):
    """Many texts with one core, all alike: one block holds them all, in tiles of 16."""
    core = "a common beginning that fills most of every text of this block and goes on for long "
    rows = [("s", k, core + chr(97 + k % 26) * 2 + chr(97 + k // 26)) for k in range(120)]
    df = spark.createDataFrame(rows, "src string, id bigint, text string").repartition(6)
    assert {tuple(r) for r in near_pairs(df, tile=16).collect()} == brute(rows)


def test_copies_nulls_and_short_texts(spark):
    rows = [("s", 1, "The same text."), ("s", 2, "the SAME text"), ("s", 3, None), ("s", 4, ""), ("s", 5, "ab"), ("s", 6, "ab"), ("t", 1, "the same text"), ("s", 2, "the SAME text"), ("s", None, "the same text")]
    df = spark.createDataFrame(rows, "src string, id bigint, text string")
    assert [tuple(r) for r in near_pairs(df).collect()] == [("s", 1, 2)]
    assert near_pairs(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60_000))
    rows = [("s", 1, long), ("s", 2, long[:50_000]), ("s", 3, long[:20_000])]
    df = spark.createDataFrame(rows, "src string, id bigint, text string")
    assert {tuple(r) for r in near_pairs(df).collect()} == brute(rows)


def test_the_sketch_never_rules_out_a_near_pair():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.choice([20, 120, 400, 1500])
        a = "".join(rng.choice("abcdefgh") for _ in range(n))
        b = list(a)
        for _ in range(n // rng.choice([9, 12, 30])):
            b[rng.randrange(n)] = rng.choice("abcdefgh")
        b = "".join(b)
        ga, gb = grams(a), grams(b)
        exact = len(ga & gb) / len(ga | gb)
        assert likeness([a], [b])[0] == pytest.approx(exact)
        s = Sketches([a, b], "x")
        assert s.size.tolist() == [len(ga), len(gb)]
        apart = sum(int(np.bitwise_count(w[0] ^ w[1])) for w in s.sketch)
        assert apart <= len(ga ^ gb)
        if exact >= 0.6:
            assert likeness([a], [b], 0.6)[0] > 0
            words = width(min(len(ga), len(gb)))
            if words > 4:
                x, y = (np.bitwise_xor.reduce(np.frombuffer(w, np.uint64).reshape(-1, words)) for w in s.wide)
                assert np.bitwise_count(x ^ y).sum() <= len(ga ^ gb)


def test_reading_order_does_not_matter(spark, edited):
    df = spark.createDataFrame(edited, "src string, id bigint, text string")
    a = {tuple(r) for r in near_pairs(df.repartition(7)).collect()}
    b = {tuple(r) for r in near_pairs(df.orderBy(F.desc("id")).coalesce(1)).collect()}
    assert a == b


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    from turnloom.llm.neardup import components

    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 620)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)]
    links = [*chain, *star, *loose, (7, 3), (3, 7), (9, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = union_find(links, {x for p in links for x in p})
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {x for x, y in links if x == y}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_groups(spark, sf):
    from turnloom.llm.neardup import near_groups

    docs = _short_texts(spark, sf)
    rows = near_groups(docs).collect()
    pairs = brute([(r.src, r.id, r.text) for r in docs.where("text is not null").collect()])
    want = union_find([((s, a), (s, b)) for s, a, b in pairs], {(r.src, r.id) for r in rows})
    assert len(rows) == len(want) and {(r.src, r.id): (r.src, r.group_id) for r in rows} == want


def test_a_third_of_all_rows_is_one_text(spark):
    from turnloom.llm.neardup import near_groups

    rng = random.Random(6)
    hot = "the one text that a third of all records share, delivered again and again"
    rows = [("s", k, hot if k % 3 == 0 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))) for k in range(3000)]
    rows.append(("s", 5000, hot + " and again"))
    got = {r.id: r for r in near_groups(spark.createDataFrame(rows, "src string, id bigint, text string").repartition(8)).collect()}
    assert len(got) == 3001 and got[2997].group_id == 0 and got[5000].group_id == 0 and got[1].group_id == 1
    assert (got[0].copies, got[0].links, got[5000].copies, got[5000].links, got[1].links) == (1000, 1, 1, 1, 0)


def test_large_blocks_are_seen_before_they_are_sorted(spark):
    """Blocks above a tile, as seen in a part of the rows, are cut by set size and digest; the pairs stay the same."""
    from turnloom.llm.neardup import _blocks, large_blocks

    core = "a common beginning that fills most of every text of this block and goes on for long "
    rows = [("s", k, core + " ".join(chr(97 + (k * j) % 26) * 3 for j in range(1, 2 + k % 12))) for k in range(150)]
    df = spark.createDataFrame(rows, "src string, id bigint, text string").repartition(3)
    large = large_blocks(df, 14, 16)
    assert large and all(len(e) == -(-150 // 16) - 1 or len(e) < 10 for e in large.values())
    tiles = _blocks(df, 14, 16).where("tile > 0").groupBy("key", "tile").count().collect()
    assert max(r["count"] for r in tiles) <= 40 and len(tiles) > len(large)
    got, want = {tuple(r) for r in near_pairs(df, tile=16).collect()}, brute(rows)
    assert got == {tuple(r) for r in near_pairs(df).collect()} <= want and len(got) >= 0.998 * len(want)
    assert {tuple(r) for r in near_pairs(df, bands=0, tile=16).collect()} == want  # by tiles alone


def test_nothing_is_lost_without_bands(spark, edited):
    df = spark.createDataFrame(edited, "src string, id bigint, text string")
    assert {tuple(r) for r in near_pairs(df, bands=0, tile=20).collect()} == brute(edited)
