"""Expectations of single operators, and folds against plain Python on random input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import labels, text as T, vectors as V
from weft.operators import adapters, agents, audit, chunking, context, ingest, retrieval, selection, sessions
from weft.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosine(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, V.cosine(arr(1, 0, 0), arr(1, 0, 0))) == 1
    assert one(spark, V.cosine(arr(1, 0), arr(0, 1))) == 0
    assert one(spark, V.cosine(arr(1, 0), arr(-1, 0))) == -1
    assert one(spark, V.cosine(arr(1, 0), arr(1, 0, 0))) == 0 and one(spark, V.cosine(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, V.angular_score(F.lit(-1.0))) == 0
    assert one(spark, V.pad(arr(1, 2, 3), 2)) == [1, 2] and one(spark, V.pad(arr(1), 3)) == [1, 0, 0]
    assert abs(one(spark, V.norm(V.hash_embedding(F.lit("x"), 64))) - 1) < 1e-9


def test_token_estimates_and_lines(spark):
    t = F.lit("日本\U0001f600ab")
    assert [one(spark, f(t)) for f in (T.estimate_tokens, T.estimate_tokens_floor, T.estimate_tokens_points, T.estimate_tokens_utf16)] == [3, 3, 1, 2]
    assert one(spark, T.lines(F.lit("a\r\nb\n"))) == ["a", "b"] and one(spark, T.lines(F.lit(""))) == []


def test_labels():
    assert labels.local_model("BGELARGE") == ("BAAI/bge-large-en-v1.5", 1024) and labels.local_model("?")[1] == 384


def plain_chunks(lines):
    out, n, start = [], 0, 1
    for i, line in enumerate(lines, 1):
        n += 1
        s = line.strip()
        header = (s.startswith("#") and len(s) > 1) or (len(s) > 2 and set(s) <= set("=-~^"))
        stop = i == len(lines) or n >= 40 or (not s and n >= 20) or (header and n >= 15) or (s.startswith(("```", "~~~")) and n >= 20)
        if stop or (n >= 30 and s.startswith(("def ", "class ", "function ", "pub fn ", "fn ", "const ", "let "))):
            out.append((start, i))
            n, start = 0, i + 1
    return out


def test_chunks_follow_the_rules(spark):
    rng = random.Random(1)
    texts = ["\n".join(f"Line {i}" for i in range(100)), None, "", "one", "\n".join(["x"] * 25 + [""] + ["y"] * 25)]
    for _ in range(60):
        texts.append("\n".join(rng.choice(["", "# h", "====", "```", "def f():", "let x", "plain", "plain", "plain", "  \t"]) for _ in range(rng.randrange(1, 160))))
    got = {}
    rows = chunking.chunk(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")).orderBy("start_line").collect()
    for r in rows:
        got.setdefault(int(r.artifact_id), []).append((r.start_line, r.end_line))
    assert got[0] == [(1, 40), (41, 80), (81, 100)] and 1 not in got and 2 not in got
    for i, t in enumerate(texts):
        if t:
            lines = t.split("\n")
            lines = lines[:-1] if lines[-1] == "" else lines
            assert got.get(i, []) == plain_chunks(lines), i


def test_chunk_pg(spark):
    lines = ["x"] * 20 + [""] + ["y"] * 60
    rows = chunking.chunk_pg(spark.createDataFrame([("a", "\n".join(lines)), ("b", "z\n" * 50)], "id string, content string")).orderBy("artifact_id", "start_line").collect()
    assert [(r.artifact_id, r.start_line, r.end_line) for r in rows] == [("a", 1, 20), ("a", 21, 45), ("a", 46, 81), ("b", 1, 50)]


def plain_mmr(scores, vectors, weight, cap):
    left, chosen = list(range(len(scores))), []
    while left and len(chosen) < cap:
        best, at = -math.inf, 0
        for p, i in enumerate(left):
            sims = [float(np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j])) for j in chosen if vectors[j] is not None and vectors[i] is not None]
            value = round(weight * scores[i] - (1 - weight) * (max(sims) if sims else 0.0), 12)
            if not chosen:
                value = -p
            if value > best:
                best, at = value, p
        chosen.append(left.pop(at))
    return chosen


def test_mmr_against_plain_python():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 45))
        vectors = [None if rng.random() < 0.1 else rng.normal(size=8) for _ in range(n)]
        scores = np.sort(rng.random(n))[::-1] * 0.02
        assert selection.mmr_order(scores, vectors, 0.5, 30) == plain_mmr(scores, vectors, 0.5, 30)


def test_packing(spark):
    shape = "query_id string, id string, score double, rank int, tokens long, budget long"
    two = [("q", "a", 1.0, 1, 100, 200), ("q", "b", 0.9, 2, 150, 200)]
    assert [r.id for r in selection.pack(spark.createDataFrame(two, shape)).collect()] == ["a"]
    rng, rows, want, want_pg = random.Random(7), [], set(), set()
    for q in range(40):
        budget = rng.choice([0, 50, 200, 1000])
        items = [(f"i{k:02}", rng.random(), k, rng.choice([0, 5, 30, 90, 400])) for k in range(rng.randrange(1, 30))]
        rows += [(f"q{q}", i, s, k, t, budget) for i, s, k, t in items]
        total = 0
        for i, s, k, t in sorted(items, key=lambda x: (-(x[1] / x[3] if x[3] else math.inf), -x[1], x[2])):
            if budget > 0 and t <= budget // 2 and total + t <= budget:
                total += t
                want.add((f"q{q}", i))
        total = 0
        for i, s, k, t in items:
            if total + t <= budget:
                total += t
                want_pg.add((f"q{q}", i))
    df = spark.createDataFrame(rows, shape)
    assert {tuple(r) for r in selection.pack(df).collect()} == want
    assert {tuple(r) for r in selection.pack_in_order(df).collect()} == want_pg


def test_vector_topk_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).round(3)
    x[7] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(120)] + [(500, None), (501, [float("nan")] * 8), (502, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = vectors.filter("id < 9").select(F.col("id").alias("query_id"), "embedding")
    f = np.float32(x).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    got = {}
    for r in retrieval.vector_topk(asked, vectors, 6, 8, block=4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    for q in range(9):
        want = sorted(range(120), key=lambda i: (-round(float(f[q] @ f[i]), 9), i))[:6]
        assert [got[q][k] for k in range(1, 7)] == want
    assert retrieval.vector_topk(asked.limit(0), vectors, 6, 8).count() == 0


def test_lexical_wildcards_and_case(spark):
    spans = spark.createDataFrame([("s1", "art", 1, "The ÉTÉ is Hot"), ("s2", "art", 0, "cold_start"), ("s3", "a", None, None), ("s2", "art", 0, "cold_start"), ("s4", "b", 3, "cold start 100%")], "id string, artifact_id string, start_line int, text string")
    queries = spark.createDataFrame([("a", "HOT"), ("b", "été"), ("c", "d_s"), ("d", "cold%100"), ("e", ""), ("f", None), ("g", "%"), ("h", "ÉTÉ")], "query_id string, query string")
    got = {}
    for r in retrieval.lexical_topk(queries, spans).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    assert got == {"a": {1: "s1"}, "c": {1: "s2", 2: "s4"}, "d": {1: "s4"}, "g": {1: "s2", 2: "s1", 3: "s4"}, "h": {1: "s1"}}
    assert {r.query_id for r in retrieval.lexical_matches(queries, spans, block=2).collect()} == {"a", "c", "d", "g", "h"}


def test_metrics(spark):
    rows = [("1", ["a", "b"], ["a", "b", "c"], 3), ("2", ["a", "b"], ["c", "a", "d"], 3), ("3", ["a", "b"], ["c", "d"], 2), ("4", [], [], 3)]
    got = {r.query_id: (r.recall, round(r.precision, 4), r.mrr) for r in audit.evaluate(spark.createDataFrame(rows, "query_id string, expected array<string>, results array<string>, k int")).collect()}
    assert got == {"1": (1, 0.6667, 1), "2": (0.5, 0.3333, 0.5), "3": (0, 0, 0), "4": (1, 0, 0)}


def test_diff(spark):
    shape = "query_id string, id string, rank int, score double"
    a = spark.createDataFrame([("q", "1", 1, 0.9), ("q", "2", 2, 0.8), ("q", "3", 3, 0.1)], shape)
    b = spark.createDataFrame([("q", "1", 1, 0.95), ("q", "2", 2, 0.8), ("q", "4", 3, 0.1)], shape)
    assert {r.id: r.change for r in audit.diff(a, b).collect()} == {"1": "reranked", "3": "removed", "4": "added"}
    q = spark.createDataFrame([("q",), ("r",)], "query_id string")
    assert {r.query_id: r.summary for r in audit.diff_summary(audit.diff(a, b), q).collect()} == {"q": "1 added, 1 removed, 1 reranked", "r": "No changes"}


M = "id string, session_id string, role string, content string, metadata string, sequence_number int, created_at timestamp"


def test_history_and_replay(spark):
    rows = [("m0", "s", "user", "Hello", None, 0, None), ("m1", "s", "assistant", "Hi there!", None, 1, None), ("m2", "s", "user", "How are you?", None, 2, None)]
    df = spark.createDataFrame(rows, M)
    assert sessions.conversation_history(df).first().history == "User: Hello\n\nAssistant: Hi there!\n\nUser: How are you?"
    turns = sessions.replay(df).orderBy("turn").collect()
    assert [(r.user_message_id, r.assistant_message_id) for r in turns] == [("m0", "m1"), ("m2", None)]
    long = spark.createDataFrame([(f"m{i}", "s", "user", f"{i}" * 1000, None, i, None) for i in range(10)], M)
    kept = {r.id for r in sessions.history_window(long, 1000).collect()}
    assert "m9" in kept and "m0" not in kept and "m1" not in kept and len(kept) == 4
    assert sessions.conversation_history(spark.createDataFrame([], M)).count() == 0


def test_agents(spark):
    rows = [("m0", "s", "user", "q", None, 0, None), ("m1", "s", "assistant", "a", '{"agent_id": "x"}', 1, None), ("m2", "s", "assistant", "b", '{"agent_id": "y"}', 2, None), ("m3", "s", "assistant", "c", "{broken", 3, None)]
    people = spark.createDataFrame([("x", "Xeno", "m1")], "id string, name string, model string")
    rel = agents.named_relations(agents.relations(spark.createDataFrame(rows, M), F.lit("agree")), people)
    assert {(r.from_name, r.to_name, r.to_model) for r in rel.collect()} == {("Xeno", "unknown", "?"), ("unknown", "Xeno", "m1")}


def test_ingest_actions(spark):
    held = spark.createDataFrame([("1", "a", "same"), ("2", "b", "old"), ("3", "c", None)], "id string, path string, content string")
    new = spark.createDataFrame([("a", "same"), ("b", "new"), ("d", "x"), ("c", None)], "path string, content string")
    assert {r.path: r.action for r in ingest.classify(new, held).collect()} == {"a": "skip", "b": "update", "d": "create", "c": "skip"}
    assert {r.path: r.content for r in ingest.upsert(held, new).collect()} == {"a": "same", "b": "new", "c": None, "d": "x"}


def test_merge_adjacent(spark):
    shape = "query_id string, citation int, path string, start_line int, end_line int, text string, tokens long, score double"
    rows = [("q", 1, "a", 1, 5, "x", 1, 0.5), ("q", 2, "a", 10, 12, "y", 1, 0.7), ("q", 3, "a", 18, 19, "z", 1, 0.1), ("q", 4, "b", 20, 21, "w", 1, None)]
    got = adapters.merge_adjacent(spark.createDataFrame(rows, shape)).orderBy("island").collect()
    assert [(r.start_line, r.end_line, r.text, r.span_count) for r in got] == [(1, 12, "x\n\ny", 2), (18, 19, "z", 1), (20, 21, "w", 1)]


def test_working_set_of_nothing(spark):
    shape = "query_id string, citation int, id string, artifact_id string, path string, start_line int, end_line int, text string, tokens long, score double"
    requests = spark.createDataFrame([("q", "?", 0)], "query_id string, query string, budget long")
    row = context.working_sets(spark.createDataFrame([], shape), requests).first()
    assert row.text == "" and row.n_spans == 0 and row.utilisation == 0


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.md").write_text("# A\n")
    (tmp_path / "node_modules/b.md").write_text("skip")
    (tmp_path / "src/c.bin").write_bytes(b"\xff\xfe\x00")
    assert {(r.path, r.content) for r in files.read_tree(spark, str(tmp_path)).collect()} == {("src/a.md", "# A\n")}
    (tmp_path / "q.jsonl").write_text('{"question": "x", "answer_terms": ["a"]}\n\n')
    assert files.read_questions(spark, str(tmp_path / "q.jsonl")).count() == 1
    (tmp_path / "g.json").write_text('[{"query": "x", "expected_paths": ["a"], "k": 3}]')
    assert files.read_golden(spark, str(tmp_path / "g.json")).first().k == 3
    rows = spark.createDataFrame([("p", "package.json", True), ("p", "x.ts", False), ("r", "Cargo.toml", False), ("u", "z", False)], "project string, path string, ts boolean")
    assert {r.project: r.project_type for r in files.project_type(rows, "project", F.col("ts")).collect()} == {"p": "typescript", "r": "rust", "u": "unknown"}


def test_streaming_ingest(spark, tmp_path):
    from weft.streaming import ingest as streaming

    shape = "path string, content string, arrived_at timestamp"
    for k, rows in enumerate(([("a", "one"), ("b", "two")], [("a", "three")])):
        spark.createDataFrame([(p, c, None) for p, c in rows], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = {"df": spark.createDataFrame([], "id string, path string, content string")}

    def write(df, number):
        df.write.parquet(str(tmp_path / f"out{number}"))
        store["df"] = spark.read.parquet(str(tmp_path / f"out{number}"))

    stream = streaming.watch_parquet(spark, str(tmp_path / "in"), shape, 1)
    streaming.ingest_stream(stream, lambda: store["df"], write, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.path for r in store["df"].collect()} == {"a", "b"}


def test_flagship_is_stable_under_partitioning(spark):
    import os

    from weft.plans.compile import Compiler

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    asked = read("compile_requests").select(F.col("id").alias("query_id"), "query", F.col("token_budget").alias("budget"))
    runs = [{tuple(r) for r in Compiler(read("spans").repartition(n), read("artifacts")).compile(asked).select("query_id", "context_hash").collect()} for n in (1, 13)]
    assert runs[0] == runs[1]


def test_searches_compile_to_their_own_budget(spark):
    from weft.plans.compile import Compiler, Config

    spans = [(f"s{i:02}", f"a{i % 3}", i, i, f"word{i} merge", [float(i + 1), 1.0, 0.5 * (i % 4)], 900) for i in range(30)]
    shape = "id string, artifact_id string, start_line int, end_line int, text string, embedding array<float>, token_count int"
    asked = spark.createDataFrame([("q", "merge", [1.0, 1.0, 1.0], 10), ("r", "word3", [9.0, 1.0, 0.0], None)], "query_id string, query string, embedding array<float>, budget long")
    paths = spark.createDataFrame([(f"a{i}", f"p{i}") for i in range(3)], "id string, path string")
    config = Config(dimension=3, enable_mmr=False)
    compiler = Compiler(spark.createDataFrame(spans, shape), paths, config)
    first = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "citation").collect())
    for found, budget, mmr in ((compiler.similarity_search(asked, 3), 6000, False), (compiler.mmr_search(asked, 3, 8), 8000, True)):
        whole = Compiler(spark.createDataFrame(spans, shape), paths, Config(dimension=3, enable_mmr=mmr))
        want = whole.stages(asked.withColumn("budget", F.lit(budget)))["final"].filter("citation <= 3")
        assert first(found) == first(want) and len(first(found)) == 6
    assert compiler.config == config


def test_history_keeps_long_role_names(spark):
    row = [("m", "s", "r" + "X" * 1500, "hello", 1, None)]
    shape = "id string, session_id string, role string, content string, sequence_number int, created_at timestamp"
    got = sessions.conversation_history(spark.createDataFrame(row, shape)).first().history
    assert got == "R" + "x" * 1500 + ": hello"
