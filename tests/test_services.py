"""Indexes, embedding providers, the session manager and what surrounds the compiler."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import sql
from weft.operators import audit, embedding as E, index as I, manager as M, retrieval, service
from weft.plans.compile import Compiler, Config
from weft.sources import files
from weft.sources.store import ParquetStore

V = "id string, artifact_id string, start_line int, embedding array<float>"


def vectors(spark, n=400, dim=8):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    rows = [(f"v{i:03}", f"a{i % 7}", i, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows + rows[:30] + [("bad", "a", 1, [1.0]), ("none", "a", 1, None)], V)


def asked(df, n=20):
    return df.filter(f"id < 'v{n:03}'").distinct().select(F.col("id").alias("query_id"), "embedding")


def test_ties_of_the_exact_search_are_by_artifact_and_line(spark):
    rows = [("z", "a2", 1, [1.0, 0.0]), ("y", "a1", 9, [2.0, 0.0]), ("x", "a1", None, [3.0, 0.0]), ("w", "a1", 2, [1.0, 0.0]), ("w", "a1", 2, [1.0, 0.0]), ("far", "a0", 1, [0.0, 1.0])]
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    for k in (2, 4, 9):
        got = [r.id for r in retrieval.vector_topk(q, spark.createDataFrame(rows, V).repartition(3), k, 2).orderBy("rank").collect()]
        assert got == ["w", "y", "x", "z", "far"][:k]


def test_repeated_rows_take_no_places(spark):
    rows = [("a", "p", 1, [1.0, 0.01 * 0])] * 50 + [(f"b{i}", "p", 1, [1.0, 0.1 * (i + 1)]) for i in range(5)]
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.id for r in retrieval.vector_topk(q, spark.createDataFrame(rows, V).coalesce(1), 3, 2).orderBy("rank").collect()] == ["a", "b0", "b1"]


def test_lexical_limit_before_the_shuffle(spark):
    rows = [(f"s{i:03}", f"a{i % 5}", 100 - i, "The Needle is here") for i in range(100)] + [("n", "a", None, None)]
    spans = spark.createDataFrame(rows + rows, "id string, artifact_id string, start_line int, text string").repartition(4)
    q = spark.createDataFrame([("q", "needle"), ("r", "n__dle"), ("none", ""), ("null", None)], "query_id string, query string")
    got = retrieval.lexical_topk(q, spans, 7).orderBy("query_id", "rank").collect()
    want = [r[0] for r in sorted(rows[:100], key=lambda r: (r[1], r[2], r[0]))[:7]]
    assert [r.id for r in got if r.query_id == "q"] == want == [r.id for r in got if r.query_id == "r"] and len(got) == 14


def test_indexes_are_saved_checked_and_built_anew(spark, tmp_path):
    df = vectors(spark)
    exact = retrieval.vector_topk(asked(df), df, 5, 8)
    for kind in (I.ExactIndex, I.CellIndex):
        at = str(tmp_path / kind.kind)
        first = kind.load_or_build(spark, at, df, 8)
        assert first.size() == 400 and first.kind == kind.kind
        again = I.VectorIndex.load(spark, at)
        found = again.search(asked(df), 5)
        share = I.overlap(found, exact).agg(F.avg("overlap")).first()[0]
        assert share == 1 if kind is I.ExactIndex else share >= 0.8
        about = json.loads(spark.read.text(f"{at}/about").first().value)
        for change in ({"version": 2}, {"checksum": "0-0-0"}):
            spark.createDataFrame([(json.dumps(about | change),)], "value string").write.mode("overwrite").text(f"{at}/about")
            with pytest.raises(I.StaleIndex):
                I.VectorIndex.load(spark, at)
        assert kind.load_or_build(spark, at, df, 8).size() == 400
    empty = df.limit(0)
    assert I.ExactIndex.build(empty, 8).search(asked(df), 3).count() == 0 and I.CellIndex.build(empty, 8).search(asked(df), 3).count() == 0


def test_embedding_providers(spark):
    spans = spark.createDataFrame([("a", "one two", [1.0, 2.0, 3.0], "old", 1), ("b", "three", None, None, 2), ("c", None, None, None, 3), ("d", "four", [1.0], "old", 4)], "id string, text string, embedding array<float>, model string, fresh2 int")
    lengths = E.encoder_provider("lengths", 3, lambda: lambda texts: np.array([[len(t), 1, 0] for t in texts]))
    got = {r.id: (r.model, r.embedding) for r in E.attach(spans, lengths).collect()}
    assert got == {"a": ("old", [1, 2, 3]), "b": ("lengths", [5, 1, 0]), "c": (None, None), "d": ("lengths", [4, 1, 0])}
    assert E.attach(spans, E.provider("hash", "bgelarge")).filter("size(embedding) = 1024").count() == 3
    assert E.provider("remote", encoders={"remote": lengths}) is lengths and E.provider("local").model == "hash-384"
    with pytest.raises(LookupError):
        E.provider("local", forbid_fallbacks=True)
    with pytest.raises(LookupError):
        E.provider("ollama")


def test_session_manager(spark, tmp_path):
    corpus = spark.createDataFrame([(f"s{i}", "a", i, i, f"merge word{i}", [float(i + 1), 1.0], 10) for i in range(5)], "id string, artifact_id string, start_line int, end_line int, text string, embedding array<float>, token_count int")
    compiler = Compiler(corpus, spark.createDataFrame([("a", "p.md")], "id string, path string"), Config(dimension=2, enable_mmr=False))
    made = M.SessionManager(ParquetStore(spark, str(tmp_path / "store")), compiler)
    assert made.sessions().count() == 0 and made.full().count() == 0
    made.create_sessions(spark.createDataFrame([("x", "u1", "First"), ("y", "u1", "Second"), ("z", None, None), (None, "u", "no id")], "id string, user_id string, title string"))
    made.create_sessions(spark.createDataFrame([("x", "u9", "again")], "id string, user_id string, title string"))
    assert {(r.id, r.user_id) for r in made.sessions().collect()} == {("x", "u1"), ("y", "u1"), ("z", None)}
    shape = "id string, session_id string, role string, content string, extra int"
    made.add_messages(spark.createDataFrame([("m1", "x", "user", "Hello", 1), ("m2", "x", "assistant", "Hi", 1), ("m3", "x", "robot", "?", 1), ("m4", "gone", "user", "?", 1), (None, "x", "user", "?", 1)], shape))
    made.add_messages(spark.createDataFrame([("m2", "x", "user", "again", 1), ("m5", "x", "user", "How?", 1), ("m6", "y", "user", "Yes", 1)], shape))
    assert {(r.id, r.sequence_number) for r in made.messages().collect()} == {("m1", 0), ("m2", 1), ("m5", 2), ("m6", 0)}
    sets = made.add_user_messages(spark.createDataFrame([("m7", "y", "merge", None), ("m8", "x", "word3", 5)], "id string, session_id string, content string, budget int"))
    assert {(r.message_id, r.session_id) for r in sets.collect()} == {("m7", "y"), ("m8", "x")}
    texts = {r.message_id: r.text for r in sets.collect()}
    assert "merge word0" in texts["m7"] and texts["m8"] == ""
    full = {r.id: (r.n_messages, len(r.working_sets or [])) for r in made.full().collect()}
    assert full == {"x": (4, 1), "y": (2, 1), "z": (0, 0)}
    assert {r.session_id: r.history for r in made.history().collect()}["y"] == "User: Yes\n\nUser: merge"
    assert made.replay().filter("working_set_id is not null").count() == 2
    made.update_sessions(spark.createDataFrame([("y", "New", None)], "id string, title string, metadata string"))
    assert {r.title for r in made.sessions().collect()} == {"First", "New", None}
    made.delete_sessions(spark.createDataFrame([("x",)], "id string"))
    assert made.messages().select("session_id").distinct().collect() == [("y",)] and made.working_sets().count() == 1 and made.sessions().count() == 2
    one = M.SessionManager(ParquetStore(spark, str(tmp_path / "pg")), compiler, first_number=1)
    one.create_sessions(spark.createDataFrame([("x", None)], "id string, user_id string"))
    for name in "ab":
        one.add_messages(spark.createDataFrame([(name, "x", "user", "t", 0)], shape))
    assert [r.sequence_number for r in one.messages().orderBy("id").collect()] == [1, 2]


def test_a_write_that_did_not_end_is_not_read(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    rows = spark.range(3)
    store.append("t", rows)
    store.append("t", rows)
    (tmp_path / "t" / "00000001-add" / "_SUCCESS").unlink()
    assert store.read("t", "id long").count() == 3
    store.replace("t", rows.limit(1))
    store.append("t", rows)
    assert store.read("t", "id long").count() == 4


def test_sql_functions(spark):
    content = "\n".join(["# T", *["x"] * 60, "", "y"])
    spark.createDataFrame([("a", content), ("b", ""), ("c", None)], "id string, content string").createOrReplaceTempView("texts")
    sql.register(spark, spark.createDataFrame([("q", "t")], "query_id string, text string"))
    rows = spark.sql("SELECT id, s.* FROM texts, LATERAL extract_spans(content) s ORDER BY start_line").collect()
    assert [(r.id, r.start_line, r.end_line) for r in rows] == [("a", 1, 40), ("a", 41, 62), ("a", 63, 63)]
    row = spark.sql("SELECT estimate_tokens('日本') AS t, cosine_similarity(array(1f, 0f), array(1f, 0f)) AS a, cosine_similarity(array(1f), array(1f, 0f)) AS b, cosine_similarity(array(0f), array(1f)) AS c").first()
    assert (row.t, row.a, row.b, row.c) == (2, 1, 0, 0) and spark.sql("SELECT text FROM compile_context").count() == 1


def test_settings_and_ways_in(spark):
    rows = spark.createDataFrame([(None,), ("",), ("sqlite",), ("sqlite:/x.db",), ("postgres://u@h/d",), ("postgresql://h",), ("oracle",)], "s string")
    got = [tuple(r.k) for r in rows.select(service.storage_kind(F.col("s"), "def.db").alias("k")).collect()]
    assert got == [("sqlite", "def.db")] * 3 + [("sqlite", "/x.db"), ("postgres", "postgres://u@h/d"), ("postgres", "postgresql://h"), ("sqlite", "def.db")]
    rows = spark.createDataFrame([(None,), ("not json",), ('{"token_budget": 5, "mmr_lambda": 0.2}',), ('{"enable_mmr": false}',)], "s string")
    got = [tuple(r.k) for r in rows.select(service.pg_config(F.col("s")).alias("k")).collect()]
    assert got == [(8000, True, 0.5, 50)] * 2 + [(5, True, 0.2, 50), (8000, False, 0.5, 50)]
    sets = spark.createDataFrame([("q", "why", "t" * 2000)], "query_id string, query string, text string")
    assert service.ask(sets).first().answer == "t" * 2000 == service.ask(sets, "auto").first().answer
    assert service.ask(sets, "local", lambda q, c: F.concat(q, F.length(c).cast("string"))).first().answer == "why1500"
    with pytest.raises(LookupError):
        service.ask(sets, "local")
    cited = spark.createDataFrame([("q", 2, "b", 0.2), ("q", 1, "a", 0.9), ("p", 1, "c", None)], "query_id string, citation int, id string, score double")
    assert [r.id for r in service.lazy_documents(cited)] == ["c", "a", "b"] and [r.id for r in service.lazy_documents(cited, 0.5)] == ["a"]
    with pytest.raises(ValueError):
        service.retriever(None, "nearest")


def test_retrievers(spark):
    corpus = spark.createDataFrame([(f"s{i}", "a", i, i, f"merge word{i}", [float(i + 1), 1.0], 10) for i in range(9)], "id string, artifact_id string, start_line int, end_line int, text string, embedding array<float>, token_count int")
    compiler = Compiler(corpus, spark.createDataFrame([("a", "p.md")], "id string, path string"), Config(dimension=2, enable_mmr=False))
    requests = spark.createDataFrame([("q", "merge", [1.0, 1.0])], "query_id string, query string, embedding array<float>")
    assert service.retriever(compiler, k=3)(requests).count() == 3 == service.retriever(compiler, "mmr", k=3)(requests).count()
    assert service.retriever(compiler, "similarity_score_threshold", k=3, least=0.5)(requests).count() == 0
    counted = Compiler(corpus, spark.createDataFrame([("a", "p.md")], "id string, path string"), Config(dimension=2), count=lambda text: F.size(F.split(text, " ")).cast("long"))
    row = counted.compile(requests).first()
    assert row.tokens_used == len(row.text.split(" "))


def test_order_statistics_of_many_values(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 500):
        x = rng.integers(0, 60, n)
        counts = spark.createDataFrame([(float(v), int((x == v).sum())) for v in set(x.tolist())], "v double, c long")
        row, ordered = audit.order_statistics(counts).first(), sorted(x.tolist())
        assert (row.p50, row.p99) == (ordered[n // 2], ordered[min(int(n * 0.99), n - 1)])


def test_saved_tables_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    files.save_corpus({"t": df}, str(tmp_path / "c"))
    assert sorted(map(tuple, files.load_corpus(spark, str(tmp_path / "c"), ["t"])["t"].collect())) == [("a", 1), ("b", 2)]
    files.export_sessions(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2


def test_jdbc_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark.range(10).selectExpr("cast(id as int) as id", "id * 2 as n").write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    except Exception as gone:  # no such driver in this Spark
        pytest.skip(str(gone)[:80])
    whole = files.read_jdbc(spark, url, "t", driver=driver)
    assert whole.count() == 10
    ranged = files.read_jdbc(spark, url, "t", "id", 3, driver=driver)
    assert ranged.count() == 10 and ranged.rdd.getNumPartitions() == 3
