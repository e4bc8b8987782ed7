import hashlib
import random

from pyspark.sql import functions as F

from weft.llm import history as H

A = "id string, path string, content string, content_hash string, rid string"
I = "batch_id long, item_id long, path string, content string, content_hash string, digest string, turn int"  # noqa: E741


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def cases(spark, artifacts, items):
    a = spark.createDataFrame([(*x, "r") for x in artifacts], A)
    i = spark.createDataFrame([(*x, "d", 0) for x in items], I)
    return {r.item_id for r in H.screen_items(a, i).collect() if r.is_case}


def test_rules_and_turns(spark):
    base, other = text(1), text(2)
    near = base + " tail"
    artifacts = [("a1", "docs/Guide.md", base, sha(base)), ("a2", "x/null.md", None, None), ("a3", "y/h.md", None, sha("hidden")), ("a4", "z/e.md", "", sha(""))]
    items = [
        (1, 1, "n/1", None, " SHA256:" + sha(base).upper()),  # digest in another spelling
        (1, 2, "n/2", None, sha(base)[:16]),  # shortened
        (1, 3, "./DOCS\\.\\tmp/..//gu%69de.MD ", None, None),  # the same path
        (1, 4, "docs/guide.md", "entirely different words here and there", None),  # a path alone is not enough
        (1, 5, "n/5", near, None),  # similar content
        (1, 6, "n/6", other, None),  # new
        (2, 7, "n/7", other + " more", None),  # similar to an accepted item
        (2, 8, "n/8", None, sha("hidden")),
        (2, 9, "n/9", None, None),
        (2, 10, "N/9", None, None),  # the same path as an accepted item
        (2, 11, "n/11", None, "abc" * 8),
        (3, 12, "n/12", None, "abc" * 4),  # begins an accepted digest
        (3, 13, "n/13", "", None),  # the digest of the empty text
        (3, 13, "n/13", "", None),
        (None, 14, None, None, None),
    ]
    assert cases(spark, artifacts, items) == {1, 2, 3, 5, 7, 8, 10, 12, 13}


def test_rejected_items_do_not_count(spark):
    words = text(7, 100).split()
    a, b, c = " ".join(words[:80]), " ".join(words[8:88]), " ".join(words[16:96])
    # b is like a, c is like b but not like a: b is a case, so c is new
    assert cases(spark, [("x", "p", a, None)], [(1, 1, "p1", b, None), (1, 2, "p2", c, None)]) == {1}
    assert cases(spark, [("x", "p", "nothing alike", None)], [(1, 1, "p0", a, None), (1, 2, "p1", b, None), (2, 3, "p2", c, None)]) == {2}


def test_chain_against_a_loop(spark):
    rng = random.Random(8)
    words = text(9, 400).split()
    items = []
    for k in range(40):
        s = rng.randrange(0, 60) * 4
        items.append((k // 10, k, f"p{k}", " ".join(words[s : s + 80]), None))
    accepted, want = [], set()
    for _, k, _, t, _ in items:
        w = t.split()
        s = set(zip(w, w[1:], w[2:]))
        if any(len(s & o) >= 0.7 * len(s | o) - 1e-9 for o in accepted):
            want.add(k)
        else:
            accepted.append(s)
    assert cases(spark, [("x", "p", "nothing alike", None)], items) == want


def test_index_is_appended(spark):
    index = H.SegmentIndex(spark)
    row = lambda rid, t: (rid, "p/" + rid, t, None)
    shape = "rid string, path string, content string, content_hash string"
    index.append(spark.createDataFrame([row("a", text(1))], shape))
    batch = spark.createDataFrame([row("b", text(1) + " z"), row("c", text(2))], shape).withColumn("turn", F.col("rid"))
    found = {r.rid: r.is_case for r in index.screen(batch).collect()}
    assert found == {"b": True, "c": False}
    index.append(batch.filter("rid = 'c'").drop("turn"))
    again = spark.createDataFrame([row("d", text(2) + " z")], shape).withColumn("turn", F.col("rid"))
    assert [r.is_case for r in index.screen(again).collect()] == [True]


def test_empty(spark):
    assert cases(spark, [], []) == set()
    assert cases(spark, [], [(1, 1, "p", "a b c d", None)]) == set()


def test_long_chains_are_followed_in_bounded_rounds(spark):
    # each version is similar to its neighbours only: every second one is new
    words = text(11, 2000).split()
    versions = [(1, k, f"v{k}", " ".join(words[8 * k : 8 * k + 80]), None) for k in range(40)]
    found = cases(spark, [("x", "p", "nothing alike", None)], versions)
    accepted, want = [], set()
    for _, k, _, t, _ in versions:
        w = t.split()
        own = set(zip(w, w[1:], w[2:]))
        if any(len(own & o) >= 0.7 * len(own | o) - 1e-9 for o in accepted):
            want.add(k)
        else:
            accepted.append(own)
    assert len(accepted) > 2 * H.ROUNDS and found == want


def test_segments_meet_at_the_threshold():
    import numpy as np

    rng, cut = np.random.default_rng(3), H.Segments(0.7)
    for n in (3, 10, 40, 119, 121, 200, 900, 5000):
        missed = 0
        for _ in range(150):
            common = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            extra = int(n / 0.7) - n
            left = int(rng.integers(0, extra + 1))
            a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)))) for k in (left, extra - left))
            assert H.bounded_distance(a, b, 10**9) <= 0.3 / 1.7 * (len(a) + len(b)) + 1e-9
            stored = set(cut.keys(b, cut.length_class(len(b))).tolist())
            probes = {int(k) for c in cut.classes(len(a)) for k in cut.keys(a, c)}
            missed += len(stored & probes) < (1 if min(len(a), len(b)) < H.SHORT else H.SHARED)
        assert not missed, n


def test_a_small_batch_reads_only_its_buckets(spark):
    index = H.SegmentIndex(spark, buckets=4)
    shape = "rid string, path string, content string, content_hash string"
    rows = [(f"a{n}", f"p{n}", text(n, 20 + 40 * n), None) for n in range(60)]
    index.append(spark.createDataFrame(rows, shape))
    every = set(spark.read.parquet(f"{index.folder}/segments").inputFiles())
    sketch = index.sketch(index.records(spark.createDataFrame([("b", "p", text(3, 140) + " z", None)], shape)), True)
    probes = sketch.select(F.explode("parts").alias("part"))
    read = index._get("segments", probes)
    n = read.count()
    assert 0 < n < spark.read.parquet(f"{index.folder}/segments").count() / 2 and len(every) > 12
    batch = spark.createDataFrame([("b", "p", text(3, 140) + " z", None), ("c", "q", text(99, 140), None)], shape).withColumn("turn", F.col("rid"))
    assert {r.rid: r.is_case for r in index.screen(batch, append=True).collect()} == {"b": True, "c": False}
    again = spark.createDataFrame([("d", "q2", text(99, 140) + " y", None)], shape).withColumn("turn", F.col("rid"))
    assert [r.is_case for r in index.screen(again).collect()] == [True]


def test_increments_equal_one_screening(spark):
    items = [(k // 6, k, f"p{k}", text(k % 7) + (" z" if k % 2 else ""), None) for k in range(24)]
    a, i = spark.createDataFrame([("x", "p", text(3), None, "r")], A), spark.createDataFrame([(*x, "d", 0) for x in items], I)
    whole = {r.item_id: r.is_case for r in H.screen_items(a, i).collect()}
    assert {r.item_id: r.is_case for r in H.screen_increment(a, i).collect()} == {k: v for k, v in whole.items() if k >= 18}
