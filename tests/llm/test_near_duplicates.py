import random
import re

import numpy as np
import pytest

from weft.llm import near_duplicates as N
from weft.llm.components import connected_components
from weft.llm.shingles import jaccard, shingles

SHAPE = "kind string, id string, text string, cid long, n int, size int"


def triples(text):
    w = [x.lower() for x in re.findall("[A-Za-z0-9]+", text or "")]
    return set(zip(w, w[1:], w[2:]))


def brute(rows, least=0.7):
    sets = {(k, i): triples(t) for k, i, t, *_ in rows if i is not None}
    keys = sorted(sets)
    out = set()
    for x in range(len(keys)):
        for y in range(x + 1, len(keys)):
            (ka, a), (kb, b) = keys[x], keys[y]
            s, t = sets[keys[x]], sets[keys[y]]
            if ka == kb and a != b and s and len(s & t) >= least * len(s | t) - 1e-9:
                out.add((ka, min(a, b), max(a, b)))
    return out


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[i] = f"x{rng.randrange(999)}"
        elif kind < 0.7:
            words.insert(i, f"y{rng.randrange(999)}")
        elif len(words) > 4:
            words.pop(i)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for g in range(25):
        base = [rng.choice("alpha beta gamma delta node edge token span merge index".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(5, 120))]
        for c in range(rng.randrange(1, 6)):
            out.append((rng.choice(["span", "artifact"]), f"{g:03}-{c}", edited(rng, base, rng.randrange(0, 4)), 1, 2, 3))
    out += [("span", "null", None, 0, 0, 0), ("span", "empty", "", 0, 0, 0), ("span", "two", "only two", 0, 0, 0), (None, "nokind", "a b c d", 0, 0, 0), ("span", None, "a b c d", 0, 0, 0)]
    out += [("span", f"copy{i:02}", "The same words, again and again!", 0, 0, 0) for i in range(12)]
    out += [out[0], out[0]]
    out.append(("span", "long", " ".join(f"w{i}" for i in range(30_000)), 0, 0, 0))
    out.append(("span", "long2", " ".join(f"w{i}" for i in range(29_000)), 0, 0, 0))
    return out


@pytest.fixture(scope="module")
def found(spark, rows):
    return N.NearDuplicates(spark.createDataFrame(rows, SHAPE), width=3, threshold=0.7)


def test_pairs_are_those_of_brute_force(found, rows):
    assert {tuple(r) for r in found.pairs().collect()} == brute([r for r in rows if r[0]])


def test_large_class_comes_out_as_a_star(found, rows):
    stars = {tuple(r) for r in found.pairs(expand=5).filter("id_a like 'copy%'").collect()}
    assert stars == {("span", "copy00", f"copy{i:02}") for i in range(1, 12)}


def test_large_classes_come_out_in_full(spark):
    # Above the former limit of 1,000 members: equal words in different writing, and records of a linked class.
    rows = [("span", f"c{i:04}", "one two three four five six seven eight nine ten eleven" + "." * i, 0, 0, 0) for i in range(1001)]
    rows += [("span", f"l{i}", "one two three four five six seven eight nine ten twelve", 0, 0, 0) for i in range(2)]
    found = N.NearDuplicates(spark.createDataFrame(rows, SHAPE), width=3, threshold=0.7)
    assert found.pairs().count() == found.pairs(expand=1000).count() == 1003 * 1002 // 2


def test_star_holds_equal_texts_only(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    rows = [("span", f"{'ab'[i % 2]}{i:02}", "The same words again!" + "!" * (i % 2), 0, 0, 0) for i in range(20)]
    rows += [("span", "c", "the same words again", 0, 0, 0)]
    found = N.NearDuplicates(spark.createDataFrame(rows, SHAPE), width=3, threshold=0.7)
    every = brute(rows)
    assert {tuple(r) for r in found.pairs().collect()} == every
    star = {p for p in every if p[1][0] != p[2][0] or p[1] in ("a00", "b01")}
    assert {tuple(r) for r in found.pairs(expand=5).collect()} == star


def test_groups_hold_every_record_and_count_links(found, rows):
    pairs = brute([r for r in rows if r[0]])
    degree = {}
    for k, a, b in pairs:
        degree[(k, a)] = degree.get((k, a), 0) + 1
        degree[(k, b)] = degree.get((k, b), 0) + 1
    groups = {(r.kind, r.id): r for r in found.groups().collect() if r.kind}
    assert set(groups) == {(r[0], r[1]) for r in rows if r[0] and r[1] and triples(r[2])}
    assert all(r.n_links == degree.get(k, 0) for k, r in groups.items())
    assert all(groups[(k, a)].group_id == groups[(k, b)].group_id for k, a, b in pairs)


def similar_sets(rng, n, share=0.7):
    """Two sets of about n shingles at the threshold."""
    draw = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    common = draw(n)
    extra = int(n / share) - n
    left = int(rng.integers(0, extra + 1))
    return tuple(np.unique(np.concatenate((common, draw(k)))) for k in (left, extra - left))


def tables(cut, a, b):
    way = max(cut.way(len(a)), cut.way(len(b)))
    return [np.frombuffer(t, np.int8) for t in cut.tables([a, b], np.array([way, way]))]


def test_bounds_never_exceed_the_distance():
    rng, cut = np.random.default_rng(1), N.PivotTables(0.7)
    for n in (3, 5, 60, 900, 5000):
        for _ in range(20):
            a, b = similar_sets(rng, n)
            assert abs(cut.way(len(a)) - cut.way(len(b))) <= 1
            assert N.distance_bound(*tables(cut, a, b)) <= len(np.setxor1d(a, b))


def test_tables_discard_unlike_pairs_of_every_length():
    rng, cut = np.random.default_rng(2), N.PivotTables(0.7)
    for n in (10, 60, 300, 1500, 6000):
        dropped = 0
        for _ in range(40):
            a, b = similar_sets(rng, int(0.1 * n), 0.1 / 1.9)
            dropped += N.distance_bound(*tables(cut, a, b)) > 0.3 / 1.7 * (len(a) + len(b))
        assert dropped >= 36, n


def test_similar_sets_share_a_row():
    rng, cut = np.random.default_rng(3), N.PivotTables(0.7)
    for n in (3, 4, 8, 20, 70, 100, 300, 900, 4000):
        for _ in range(150):
            a, b = similar_sets(rng, n)
            keys = [{int(k) for more in (0, 1) for k in cut.rows([x], np.array([cut.way(len(x)) + more]))[1]} for x in (a, b)]
            assert len(keys[0] & keys[1]) >= (1 if min(len(a), len(b)) < N.SHORT else N.SHARED), n


def test_shingles():
    assert len(shingles("A b, C! d")) == 2 and len(shingles("a b")) == 0 and len(shingles("日本語")) == 0
    a, b = shingles("one two three four five six seven"), shingles("one two three four five six eight")
    assert jaccard(a, b) == (4, 6)


def shuffled(spark, do):
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.length()))

    before, out = written(), do()
    return written() - before, out


def test_records_without_candidates_are_not_shuffled(spark):
    # What is shuffled of a record that is like no other are the keys of its rows: not its text and tables.
    rng = random.Random(6)
    rows = [("span", f"r{i:03}", " ".join(f"{rng.getrandbits(48):x}" for _ in range(2000)), 0, 0, 0) for i in range(300)]
    rows += [("span", "s000", rows[0][2] + " more", 0, 0, 0), ("span", "s001", rows[1][2], 0, 0, 0)]
    spark.createDataFrame(rows, SHAPE).createOrReplaceTempView("unlike")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = spark.table("unlike")
        size, out = shuffled(spark, lambda: {tuple(r) for r in N.NearDuplicates(records, width=3, threshold=0.7).pairs().collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == {("span", "r000", "s000"), ("span", "r001", "s001")}
    texts = sum(len(r[2]) for r in rows)
    assert size < 0.2 * texts, (size, texts)


def test_marked_rows_hold_all_that_are_wanted(spark, monkeypatch):
    rows, wanted = spark.range(20_000).selectExpr("cast(id as string) as k"), spark.range(0, 20_000, 100).selectExpr("cast(id as string) as k")
    for words, most in ((1 << 18, 210), (1 << 8, 600), (1, 20_000)):
        monkeypatch.setattr(N, "WORDS", words)
        kept = {r.k for r in N.marked(rows, wanted, "k").collect()}
        assert kept >= {str(i) for i in range(0, 20_000, 100)} and len(kept) <= most
        assert {r.k for r in N.marked(rows, wanted, "k", how="left_anti").collect()} == {str(i) for i in range(20_000)} - kept
    assert N.marked(rows, wanted.limit(0), "k").count() == 0


def test_empty_table(spark):
    found = N.NearDuplicates(spark.createDataFrame([], SHAPE))
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [(None, "n01"), ("n01", None), ("n02", "n02")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
