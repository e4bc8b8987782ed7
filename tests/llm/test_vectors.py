import numpy as np
import pytest

from pyspark.sql import functions as F

from weft.llm import vectors as V

SHAPE = "id string, grp string, embedding array<float>, rid long, key long, asks boolean, extra int"


def build(n, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))
    x *= rng.uniform(0.01, 20, (n, 1))
    return [(f"v{i:04}", "m1" if i % 5 else "m2", [float(v) for v in x[i]], 0, 0, False, i) for i in range(n)]


def brute(rows, k, dim):
    usable = {r[0]: (r[1], np.float32(r[2]).astype(float)) for r in rows if r[0] and r[1] and r[2] and len(r[2]) == dim and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])}
    out = {}
    for a, (g, x) in usable.items():
        sims = sorted(((-(x @ y) / np.linalg.norm(x) / np.linalg.norm(y), b) for b, (h, y) in usable.items() if b != a and h == g))
        out[a] = [(b, -s) for s, b in sims[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    out = build(300)
    out += out[:40]
    nan, inf = float("nan"), float("inf")
    out += [("bad1", "m1", None, 0, 0, True, 0), ("bad2", "m1", [1.0] * 15, 0, 0, True, 0), ("bad3", "m1", [nan] * 16, 0, 0, True, 0), ("bad4", "m1", [inf] * 16, 0, 0, True, 0), ("bad5", "m1", [0.0] * 16, 0, 0, True, 0)]
    out += [("bad6", "m1", [None] + [1.0] * 15, 0, 0, True, 0), ("bad7", None, [1.0] * 16, 0, 0, True, 0), (None, "m1", [1.0] * 16, 0, 0, True, 0)]
    return out


def test_mutual_pairs_match_brute_force(spark, rows):
    truth = {a: [b for b, s in n if s >= 0.9] for a, n in brute(rows, 5, 16).items()}
    want = {(a, b) for a in truth for b in truth[a] if a < b and a in truth[b]}
    ranked = V.similar_vectors(spark.createDataFrame(rows, SHAPE), 5, dim=16, least=0.9, tables=8, probes=4, growth=1 / 3)
    got = {tuple(r) for r in V.mutual_pairs(ranked).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50


def test_recall_of_the_ranking(spark, rows):
    truth = brute(rows, 10, 16)
    asked = F.col("id").endswith("0")
    ranked = V.similar_vectors(spark.createDataFrame(rows, SHAPE), 10, dim=16, asks=asked).collect()
    got = {}
    for r in ranked:
        got.setdefault(r.a, {})[r.rank] = r.b
    assert set(got) == {a for a in truth if a.endswith("0")}
    hits = [len(set(v.values()) & {b for b, _ in truth[a]}) / len(truth[a]) for a, v in got.items()]
    assert np.mean(hits) >= 0.9


def test_split_cells_give_the_same(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SHAPE)
    plain = {tuple(r) for r in V.mutual_pairs(V.similar_vectors(df, 5, dim=16, least=0.9, tables=4)).collect()}
    monkeypatch.setattr(V, "CELL", 4)
    split = {tuple(r) for r in V.mutual_pairs(V.similar_vectors(df, 5, dim=16, least=0.9, tables=4)).collect()}
    monkeypatch.setattr(V, "FEW", 0)
    joined = {tuple(r) for r in V.mutual_pairs(V.similar_vectors(df, 5, dim=16, least=0.9, tables=4)).collect()}
    assert plain == split == joined


def test_equal_vectors_tie_by_id(spark):
    rows = [(f"e{i}", "m", [1.0] + [0.0] * 15, 0, 0, False, 0) for i in range(9)]
    ranked = V.similar_vectors(spark.createDataFrame(rows, SHAPE), 3, dim=16, tables=2)
    got = {(r.a, r.rank): r.b for r in ranked.collect()}
    assert [got[("e0", k)] for k in (1, 2, 3)] == ["e1", "e2", "e3"] and [got[("e8", k)] for k in (1, 2, 3)] == ["e0", "e1", "e2"]


def test_empty(spark):
    assert V.similar_vectors(spark.createDataFrame([], SHAPE), 5, dim=16).count() == 0


def test_fast_transform_is_the_hadamard_matrix():
    for d in (1, 2, 4, 16, 32, 64, 128):
        h = np.ones((1, 1))
        while len(h) < d:
            h = np.block([[h, h], [h, -h]])
        x = np.random.default_rng(0).normal(size=(5, 3, d)).astype(np.float32)
        assert np.allclose(V.hadamard(x), x @ h / np.sqrt(d), atol=1e-5)


def test_cells_stay_small_and_probes_grow_slower_than_the_collection():
    index = V.CrossPolytope(64, 8, 256, 0.5)
    for n in (100, 10_000, 10**6, 10**9):
        bits = V.key_bits(n)
        assert sum(index.parts(bits)) == bits and n / 2**bits <= 2 * V.FILL
    share = [index.n_probes(V.key_bits(n)) / 2 ** V.key_bits(n) for n in (10**4, 10**6, 10**8)]
    assert share[0] > 5 * share[1] > 25 * share[2]


def test_errors_of_the_copies_bound_every_product():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64)) * 10.0 ** rng.integers(-3, 3, (2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copy, error = V.from_copies(V.small_copies(x))
    off = error[:, None] * (1 + error) + error + V.ROUNDING
    assert (np.abs(copy @ copy.T - x @ x.T) <= off).all() and error.max() < 0.04


def test_many_equal_vectors_give_a_row_a_neighbour(spark):
    rows = [(f"e{i:05}", "m", [1.0] + [0.5] * 15, 0, 0, False, 0) for i in range(6000)] + [("z", "m", [1.0, 0.4] + [0.5] * 14, 0, 0, False, 0)]
    ranked = V.similar_vectors(spark.createDataFrame(rows, SHAPE), 3, dim=16, tables=2)
    assert ranked.count() == 3 * 6001
    got = {r.b for r in ranked.filter("a = 'z'").collect()}
    assert got == {"e00000", "e00001", "e00002"}
