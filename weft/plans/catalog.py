"""Every operator as a named query over the test tables, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from weft.functions import labels, sql, text as T, vectors as V
from weft.operators import adapters, agents as A, audit, chunking, context, embedding, index, ingest, manager, retrieval, selection, service, sessions as S, stats
from weft.plans.compile import Compiler, Config
from weft.runtime import shared_dir, table, tune
from weft.sources import files
from weft.sources.store import ParquetStore
from weft.streaming import ingest as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(lambda name: table(tune(spark), d, name))

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared inputs: rows delivered twice count once ------------------------------------------------
def spans_of(t, vectors: bool = False) -> DataFrame:
    names = ["id", "artifact_id", "start_line", "end_line", "text", "model", "token_count"] + ["embedding"] * vectors
    return t("spans").select(*names).distinct()


def artifacts_of(t) -> DataFrame:
    return t("artifacts").distinct()


def messages_of(t) -> DataFrame:
    return t("messages").distinct()


def requests_of(t) -> DataFrame:
    return t("compile_requests").select(F.col("id").alias("query_id"), "query", F.coalesce("token_budget", F.lit(8000)).cast("long").alias("budget")).distinct()


def candidates_of(t, budget: int | None = None) -> DataFrame:
    """(query_id, id, score, rank, tokens, budget) of the candidate spans that exist."""
    asked = t("request_spans").distinct().select(F.col("request_id").alias("query_id"), F.col("span_id").alias("id"), "rank", F.coalesce("score", F.lit(0.0)).alias("score"))
    sizes = spans_of(t).select("id", F.greatest(F.coalesce("token_count", F.lit(0)), F.lit(0)).cast("long").alias("tokens"))
    out = asked.join(sizes, "id").join(requests_of(t).select("query_id", "budget"), "query_id")
    return out.withColumn("budget", F.lit(budget).cast("long")) if budget else out


def cited_of(t, budget: int | None = None, by: str = "artifact_id", pg: bool = False) -> DataFrame:
    """The packed candidates in canonical order with their spans and paths."""
    rows = candidates_of(t, budget)
    taken = selection.pack_in_order(rows) if pg else selection.pack(rows)
    paths = artifacts_of(t).select(F.col("id").alias("artifact_id"), "path")
    full = rows.select("query_id", "id", "score", "tokens").join(taken, ["query_id", "id"]).join(spans_of(t).drop("token_count", "model"), "id").join(paths, "artifact_id", "left")
    return context.canonical(full.withColumn("path", F.coalesce("path", F.lit("unknown"))), by)


WITH = """WITH RECURSIVE sp AS (SELECT DISTINCT id, artifact_id, start_line, end_line, text, model, token_count FROM spans),
spv AS (SELECT DISTINCT id, artifact_id, start_line, end_line, text, model, token_count, embedding FROM spans),
art AS (SELECT DISTINCT * FROM artifacts), msg AS (SELECT DISTINCT * FROM messages), ses AS (SELECT DISTINCT * FROM sessions),
num AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_number NULLS LAST, created_at NULLS LAST, id) - 1 AS position FROM msg WHERE session_id IS NOT NULL),
req AS (SELECT DISTINCT id AS query_id, query, CAST(coalesce(token_budget, 8000) AS BIGINT) AS budget FROM compile_requests)"""


def _cand(budget: str = "q.budget") -> str:
    return f""", cand AS (SELECT r.request_id AS query_id, r.span_id AS id, r.rank, coalesce(r.score, 0) AS score, CAST(greatest(coalesce(s.token_count, 0), 0) AS BIGINT) AS tokens, CAST({budget} AS BIGINT) AS budget
FROM (SELECT DISTINCT * FROM request_spans) r JOIN sp s ON s.id = r.span_id JOIN req q ON q.query_id = r.request_id)"""


def _packed(pg: bool = False, source: str = "cand", suffix: str = "") -> str:
    order = "rank, id" if pg else "CASE WHEN tokens > 0 THEN score / tokens ELSE 'inf'::DOUBLE END DESC, score DESC, rank, id"
    fits = "o.tokens <= o.budget" if pg else "o.budget > 0 AND o.tokens <= o.budget // 2"
    return f""", ord{suffix} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS n FROM {source}),
pk{suffix} AS (SELECT o.query_id, o.id, o.n, {fits} AS take, CASE WHEN {fits} THEN o.tokens ELSE 0 END AS total FROM ord{suffix} o WHERE n = 1
 UNION ALL SELECT o.query_id, o.id, o.n, {fits} AND p.total + o.tokens <= o.budget, p.total + CASE WHEN {fits} AND p.total + o.tokens <= o.budget THEN o.tokens ELSE 0 END FROM pk{suffix} p JOIN ord{suffix} o ON o.query_id = p.query_id AND o.n = p.n + 1),
packed{suffix} AS (SELECT o.* FROM ord{suffix} o JOIN pk{suffix} p ON p.query_id = o.query_id AND p.n = o.n WHERE p.take)"""


def _cited(by: str = "artifact_id", suffix: str = "") -> str:
    return f""", fulls{suffix} AS (SELECT p.query_id, p.id, p.score, p.tokens, s.artifact_id, s.start_line, s.end_line, s.text, coalesce(a.path, 'unknown') AS path FROM packed{suffix} p JOIN sp s ON s.id = p.id LEFT JOIN art a ON a.id = s.artifact_id),
cited{suffix} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}, start_line NULLS LAST, id) AS citation FROM fulls{suffix})"""


_LINE = "coalesce(CAST(start_line AS VARCHAR), '0') || '-' || coalesce(CAST(end_line AS VARCHAR), '0')"
BLOCK = f"'[' || citation || '] ' || path || chr(10) || 'Lines ' || {_LINE} || chr(10) || chr(10) || coalesce(text, '')"
BLOCK_PG = f"'--- ' || path || ' (lines ' || {_LINE} || ') ---' || chr(10) || coalesce(text, '')"
GAP, GAP_PG = "chr(10) || chr(10) || '---' || chr(10) || chr(10)", "chr(10) || chr(10)"
CITED = WITH + _cand() + _packed() + _cited()
SETS = CITED + f""", sets AS (SELECT q.query_id, q.query, q.budget, coalesce(c.text, '') AS text, coalesce(c.n, 0) AS n_spans FROM req q LEFT JOIN
(SELECT query_id, string_agg({BLOCK}, {GAP} ORDER BY citation) AS text, count(*) AS n FROM cited GROUP BY 1) c USING (query_id))"""


# ---- corpus ---------------------------------------------------------------------------------------
_COUNTS = "(SELECT count(*) FROM art) AS artifacts, (SELECT count(*) FROM sp) AS spans, (SELECT count(*) FROM ses) AS sessions, (SELECT count(*) FROM msg) AS messages, (SELECT count(*) FROM agents) AS agents, (SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) FROM sp) AS tokens"


@query(f"""{WITH} SELECT *, CASE WHEN spans > 0 THEN CAST(floor(tokens / spans) AS BIGINT) ELSE 0 END AS tokens_per_span, CASE WHEN artifacts > 0 THEN spans // artifacts ELSE 0 END AS spans_per_artifact,
CASE WHEN spans < 10 THEN 'small' WHEN spans < 1000 THEN 'optimal' WHEN spans < 10000 THEN 'large' ELSE 'very large' END AS status FROM (SELECT {_COUNTS})""")
def corpus_stats(t):
    return stats.corpus_stats(artifacts_of(t), spans_of(t), t("sessions").distinct(), messages_of(t), t("agents"))


@query(f"""{WITH}, b AS (SELECT CAST(least(floor(greatest(coalesce(token_count, 0), 0) / 200), 4) AS INT) AS bucket, count(*) AS n FROM sp GROUP BY 1)
SELECT CAST(k.i AS INT) AS bucket, CASE WHEN k.i = 4 THEN '800+' ELSE (k.i * 200) || '-' || ((k.i + 1) * 200) END AS label, coalesce(b.n, 0) AS spans, CAST(floor(coalesce(b.n, 0) * 100 / (SELECT count(*) FROM sp)) AS BIGINT) AS percent FROM range(5) k(i) LEFT JOIN b ON b.bucket = k.i""")
def token_histogram(t):
    return stats.token_histogram(spans_of(t))


@query("SELECT DISTINCT id, sha256(content) AS hash FROM artifacts")
def content_hash(t):
    return artifacts_of(t).select("id", ingest.content_hash(F.col("content")).alias("hash"))


_INCOMING = "inc AS (SELECT path, max_by(content, (arrived_at, batch_id, item_id)) AS content FROM (SELECT path, content, arrived_at, batch_id, item_id FROM ingest_items WHERE content IS NOT NULL AND path IS NOT NULL) GROUP BY path)"


def incoming_of(t) -> DataFrame:
    """The last content that arrived for each path."""
    rows = t("ingest_items").filter("content is not null and path is not null").select("path", "content", "arrived_at", "batch_id", "item_id").distinct()
    return ingest.latest(rows, ["arrived_at", "batch_id", "item_id"]).select("path", "content")


@query(f"""{WITH}, {_INCOMING} SELECT i.path, sha256(i.content) AS content_hash, a.id AS artifact_id, CASE WHEN a.id IS NULL THEN 'create' WHEN sha256(a.content) = sha256(i.content) THEN 'skip' ELSE 'update' END AS action FROM inc i LEFT JOIN art a ON a.path = i.path""")
def ingest_actions(t):
    return ingest.classify(incoming_of(t), artifacts_of(t)).select("path", "content_hash", "artifact_id", "action")


@query(f"""{WITH}, {_INCOMING}, j AS (SELECT i.*, a.id AS old FROM inc i LEFT JOIN art a ON a.path = i.path WHERE a.id IS NULL OR sha256(a.content) IS DISTINCT FROM sha256(i.content))
SELECT id, path, sha256(content) AS hash FROM art WHERE path NOT IN (SELECT path FROM j) UNION ALL SELECT sha256(path), path, sha256(content) FROM j""")
def ingest_upsert(t):
    return ingest.upsert(artifacts_of(t), incoming_of(t)).select("id", "path", ingest.content_hash(F.col("content")).alias("hash"))


_W = r"[\s\p{Z}\x{85}]"
_CHUNKS = rf"""{WITH}, raw AS (SELECT id, regexp_split_to_array(content, '\r?\n') AS l FROM art WHERE content IS NOT NULL),
cut AS (SELECT id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM raw), ln AS (SELECT id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS total FROM cut WHERE len(l) > 0),
th AS (SELECT *, CASE WHEN regexp_matches(line, '^{_W}*#.*[^\s\p{{Z}}\x{{85}}]|^{_W}*[=\-~^]{{3,}}{_W}*$') THEN 15 WHEN regexp_matches(line, '^{_W}*$|^{_W}*(```|~~~)') THEN 20
 WHEN regexp_matches(line, '^{_W}*(def |class |function |pub fn |fn |const |let )') THEN 30 ELSE 40 END AS k FROM ln),
f AS (SELECT id, i, 1 AS n, (1 >= k OR i = total) AS closed FROM th WHERE i = 1 UNION ALL SELECT th.id, th.i, CASE WHEN f.closed THEN 1 ELSE f.n + 1 END, (CASE WHEN f.closed THEN 1 ELSE f.n + 1 END >= th.k OR th.i = th.total) FROM f JOIN th ON th.id = f.id AND th.i = f.i + 1),
ch AS (SELECT f.id AS artifact_id, i - n + 1 AS start_line, i AS end_line FROM f WHERE closed),
chunks AS (SELECT artifact_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, array_to_string(cut.l[start_line:end_line], chr(10)) AS text FROM ch JOIN cut ON cut.id = ch.artifact_id)"""


@query(f"{_CHUNKS} SELECT artifact_id, sha256(artifact_id || '|' || start_line || '|' || sha256(text)) AS span_id, start_line, end_line, sha256(text) AS text_hash, CAST(ceil(strlen(text) / 4) AS BIGINT) AS token_count FROM chunks")
def chunk_spans(t):
    return chunking.chunk(artifacts_of(t)).select("artifact_id", "span_id", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"), "token_count")


@query(f"{_CHUNKS} SELECT artifact_id, count(*) AS spans_created, CAST(sum(CAST(ceil(strlen(text) / 4) AS BIGINT)) AS BIGINT) AS tokens_indexed FROM chunks GROUP BY 1")
def ingest_totals(t):
    return ingest.ingest_totals(artifacts_of(t))


@query(rf"""{WITH}, raw AS (SELECT id, regexp_split_to_array(content, '\r?\n') AS l FROM art WHERE content IS NOT NULL), cut AS (SELECT id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM raw),
bl AS (SELECT id, l, len(l) AS n, list_transform(l, lambda x: regexp_matches(x, '^[\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]*$')) AS blank FROM cut WHERE len(l) > 0),
pc AS (SELECT id, CAST(0 AS BIGINT) AS pos, CASE WHEN n <= 50 THEN n ELSE coalesce(list_filter(range(25, 9, -1), lambda i: blank[i + 1])[1], 25) END AS stop FROM bl
 UNION ALL SELECT p.id, p.stop, CASE WHEN b.n - p.stop <= 50 THEN b.n ELSE p.stop + coalesce(list_filter(range(25, 9, -1), lambda i: b.blank[p.stop + i + 1])[1], 25) END FROM pc p JOIN bl b ON b.id = p.id WHERE p.stop < b.n),
out AS (SELECT p.id, p.pos, p.stop, array_to_string(b.l[p.pos + 1:p.stop], chr(10)) AS text FROM pc p JOIN bl b ON b.id = p.id)
SELECT id AS artifact_id, CAST(pos + 1 AS INT) AS start_line, CAST(stop AS INT) AS end_line, sha256(text) AS text_hash, CAST(greatest(strlen(text) // 4, 1) AS BIGINT) AS token_count FROM out""")
def chunk_spans_pg(t):
    return chunking.chunk_pg(artifacts_of(t)).select("artifact_id", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"), "token_count")


@query(f"""{WITH} SELECT id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS bytes_up, CAST(greatest(strlen(text) // 4, 1) AS BIGINT) AS bytes_down, CAST(length(text) // 4 AS BIGINT) AS points_down,
CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) / 4) AS BIGINT) AS units_up FROM sp WHERE text IS NOT NULL""")
def token_estimates(t):
    return ingest.token_estimates(spans_of(t))


_DOOMED = "SELECT id FROM art WHERE content IS NULL OR content = ''"


def _doomed(t) -> DataFrame:
    return artifacts_of(t).filter("content is null or content = ''").select("id")


@query(f"{WITH}, d AS ({_DOOMED}) SELECT d.id, count(s.id) AS spans_deleted FROM d LEFT JOIN sp s ON s.artifact_id = d.id GROUP BY 1")
def delete_artifacts(t):
    return ingest.delete_artifacts(artifacts_of(t), spans_of(t), _doomed(t))[2]


@query(f"{WITH}, d AS ({_DOOMED}) SELECT artifact_id, count(*) AS spans FROM sp WHERE artifact_id NOT IN (SELECT id FROM d) GROUP BY 1")
def spans_after_delete(t):
    return ingest.delete_artifacts(artifacts_of(t), spans_of(t), _doomed(t))[1].groupBy("artifact_id").agg(F.count("*").alias("spans"))


@query("SELECT DISTINCT i.item_id, a.id AS artifact_id FROM ingest_items i JOIN artifacts a ON a.path = i.path")
def lookup_by_path(t):
    return t("ingest_items").select("item_id", "path").join(artifacts_of(t).select(F.col("id").alias("artifact_id"), "path"), "path").select("item_id", "artifact_id").distinct()


@query(f"{WITH} SELECT s.id, s.artifact_id, coalesce(a.path, 'unknown') AS path, s.start_line, s.end_line, s.token_count FROM sp s LEFT JOIN art a ON a.id = s.artifact_id")
def span_paths(t):
    paths = artifacts_of(t).select(F.col("id").alias("artifact_id"), "path")
    return spans_of(t).join(paths, "artifact_id", "left").select("id", "artifact_id", F.coalesce("path", F.lit("unknown")).alias("path"), "start_line", "end_line", "token_count")


@query(f"{WITH} SELECT model, len(embedding) AS dim, count(*) AS n FROM spv WHERE embedding IS NOT NULL GROUP BY 1, 2")
def embedded_spans(t):
    return spans_of(t, True).filter("embedding is not null").groupBy("model", F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))


@query("SELECT lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n, CAST(sum(CASE WHEN coalesce(strlen(content), 0) < 2000000 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM (SELECT DISTINCT * FROM artifacts) GROUP BY 1")
def extension_scan(t):
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return artifacts_of(t).groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.sum(F.when(size < files.MAX_BYTES, 1).otherwise(0)).alias("small"))


@query("SELECT id, path FROM (SELECT DISTINCT id, path, coalesce(strlen(content), 0) AS bytes FROM artifacts) WHERE bytes < 2000000 AND lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) IN (" + ", ".join(f"'{e}'" for e in files.EXTENSIONS) + ") AND NOT list_has_any(string_split(path, '/'), [" + ", ".join(f"'{s}'" for s in files.SKIP) + "])")
def wanted_files(t):
    return files.wanted_files(artifacts_of(t).select("id", "path", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes"))).select("id", "path")


@query("SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) ORDER BY path) AS n FROM (SELECT DISTINCT path FROM artifacts WHERE path LIKE '%.rs')) WHERE n <= 500 ORDER BY path LIMIT 1000")
def project_files(t):
    return files.project_files(artifacts_of(t).select("path").distinct(), "rust").select("path")


_KINDS = {"py": "python", "rs": "rust", "go": "go", "java": "java", "js": "javascript", "rb": "ruby", "php": "php"}


@query(f"""WITH k AS (SELECT string_split(path, '/')[1] AS project, split_part(path, '.', -1) AS ext FROM artifacts) SELECT project, CASE WHEN bool_or(ext = 'py') THEN 'python' WHEN bool_or(ext = 'ts') THEN 'typescript' WHEN bool_or(ext = 'js') THEN 'javascript'
{" ".join(f"WHEN bool_or(ext = '{e}') THEN '{k}'" for e, k in sorted(_KINDS.items(), key=lambda x: ["rust", "go", "java", "cpp", "ruby", "php"].index(x[1]) if x[1] not in ("python", "javascript") else 99) if k not in ("python", "javascript"))} ELSE 'unknown' END AS project_type FROM k GROUP BY 1""")
def project_types(t):
    # the test paths hold no marker files: a file's extension stands for the marker of its kind
    marks = {e: files.MARKERS[k][0] for e, k in _KINDS.items()} | {"ts": "package.json"}
    ext = F.element_at(F.split("path", "[.]"), -1)
    name = F.coalesce(F.create_map(*(F.lit(x) for kv in marks.items() for x in kv))[ext], F.col("path"))
    rows = artifacts_of(t).select(F.split("path", "/")[0].alias("project"), name.alias("path"), (ext == "ts").alias("typed"))
    return files.project_type(rows, "project", F.col("typed"))


@query(f"""{WITH}, e AS (SELECT artifact_id, left(sha256(id), 2) AS part, id || ':' || coalesce(len(embedding), 0) AS e FROM spv), p AS (SELECT artifact_id, part, count(*) AS n, sha256(string_agg(e, ',' ORDER BY e)) AS h FROM e GROUP BY 1, 2)
SELECT artifact_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, ',' ORDER BY part)) AS spans_hash FROM p GROUP BY 1""")
def spans_hash(t):
    return stats.spans_hash(spans_of(t, True))


@query(f"{WITH} SELECT id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM sp")
def span_preview(t):
    return spans_of(t).select("id", T.preview(F.col("text")).alias("preview"))


@query(f"{WITH} SELECT model, count(token_count) AS n, min(token_count) AS lowest, max(token_count) AS highest, round(avg(token_count), 6) AS mean, round(median(token_count), 6) AS median FROM sp GROUP BY 1")
def token_medians(t):
    return stats.median_stats(spans_of(t), "model", "token_count")


# ---- vectors and text functions -------------------------------------------------------------------
_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"""WITH s AS (SELECT b.vec_id AS id, round({_COS.format(a='a.embedding', b='b.embedding')}, 9) AS c FROM embeddings a, embeddings b WHERE a.vec_id = 0)
SELECT id, round(c, 6) AS score, rank FROM (SELECT id, c, CAST(row_number() OVER (ORDER BY c DESC, id) AS INT) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id = 0").select(F.col("id").alias("query_id"), "embedding")
    return retrieval.vector_topk(asked, vectors, 10, 64).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS.format(a='a.embedding', b='b.embedding')}, 9) AS c FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, round(c, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS INT) AS rank FROM s) WHERE rank <= 10""")
def cosine_topk_batch(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return retrieval.vector_topk(asked, vectors, 10, 64).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_OK = "len(embedding) = 64 AND NOT coalesce(list_contains(list_transform(embedding, lambda x: isfinite(x)), false), false)"


@query(f"{WITH} SELECT id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norm FROM spv WHERE {_OK}")
def vector_norms(t):
    return spans_of(t, True).filter(V.usable(F.col("embedding"), 64)).select("id", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query(f"""{WITH} SELECT a.id, b.id AS other, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine, round(least(greatest(1 - (1 - {_COS.format(a='a.embedding', b='b.embedding')}) / 2, 0), 1), 6) AS angular
FROM spv a JOIN spv b ON b.artifact_id = a.artifact_id AND b.start_line = a.end_line + 1 WHERE {_OK.replace('embedding', 'a.embedding')} AND {_OK.replace('embedding', 'b.embedding')} AND list_sum(list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: x * x)) > 0 AND list_sum(list_transform(CAST(b.embedding AS DOUBLE[]), lambda x: x * x)) > 0""")
def neighbour_cosine(t):
    ok = spans_of(t, True).filter(V.usable(F.col("embedding"), 64)).filter(V.norm(F.col("embedding")) > 0)
    a = ok.select("artifact_id", "id", F.col("embedding").alias("x"), (F.col("end_line") + 1).alias("line"))
    b = ok.select("artifact_id", F.col("id").alias("other"), F.col("embedding").alias("y"), F.col("start_line").alias("line"))
    cos = V.cosine(F.col("x"), F.col("y"))
    return a.join(b, ["artifact_id", "line"]).select("id", "other", F.round(cos, 6).alias("cosine"), F.round(V.angular_score(cos), 6).alias("angular"))


_HASHED = "list_transform(range(64), lambda i: ((CAST('0x' || substr(md5(coalesce(query, '')), 1, 8) AS BIGINT) + i) % 2000 - 1000) / 1000.0::DOUBLE)"


@query(f"{WITH}, h AS (SELECT query_id, {_HASHED} AS v FROM req) SELECT query_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last, CAST(len(v) AS INT) AS dim FROM h")
def hash_embedding(t):
    v = requests_of(t).select("query_id", V.hash_embedding(F.coalesce("query", F.lit("")), 64).alias("v"))
    return v.select("query_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.size("v").alias("dim"))


@query("SELECT vec_id, CAST(100 AS INT) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def padded_vectors(t):
    p = V.pad(F.col("embedding"), 100)
    return t("embeddings").select("vec_id", F.size(p).alias("dim"), F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS dim, array_to_string(list_transform(embedding[1:5], lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR)), ',') AS head FROM embeddings")
def embedding_smoke(t):
    head = F.transform(F.slice("embedding", 1, 5), lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string"))
    return t("embeddings").select("vec_id", F.size("embedding").alias("dim"), F.array_join(head, ",").alias("head"))


_LEXICAL = """, lx AS (SELECT q.query_id, s.id, s.artifact_id, s.start_line FROM req q JOIN sp s ON q.query <> '' AND translate(s.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%' || translate(q.query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '%')"""


@query(WITH + _LEXICAL + " SELECT query_id, id FROM lx")
def lexical_matches(t):
    return retrieval.lexical_matches(requests_of(t), spans_of(t))


_LEXTOP = _LEXICAL + ", lex AS (SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY artifact_id, start_line NULLS LAST, id) AS INT) AS rank FROM lx) WHERE rank <= 20)"


@query(WITH + _LEXTOP + " SELECT query_id, id, rank FROM lex")
def lexical_search(t):
    return retrieval.lexical_topk(requests_of(t), spans_of(t))


@query(f"""{WITH}{_cand()} SELECT c.query_id, c.id, round(len(list_filter(regexp_split_to_array(lower(q.query), '\\s+'), lambda w: w <> '' AND contains(lower(s.text), w))) / greatest(len(list_filter(regexp_split_to_array(lower(q.query), '\\s+'), lambda w: w <> '')), 1), 6) AS score
FROM cand c JOIN req q USING (query_id) JOIN sp s ON s.id = c.id WHERE s.text IS NOT NULL AND q.query IS NOT NULL""")
def keyword_score(t):
    rows = candidates_of(t).select("query_id", "id").join(requests_of(t).select("query_id", "query"), "query_id").join(spans_of(t).select("id", "text"), "id")
    return rows.filter("text is not null and query is not null").select("query_id", "id", F.round(T.keyword_score(F.col("query"), F.col("text")), 6).alias("score"))


@query(f"{WITH} SELECT id, artifact_id, CAST(rank AS INT) AS rank, round(1 - 0.05::DOUBLE * (rank - 1), 6) AS score FROM (SELECT id, artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY start_line NULLS LAST, id) AS rank FROM sp)")
def positional_score(t):
    rank = F.row_number().over(W.partitionBy("artifact_id").orderBy(F.col("start_line").asc_nulls_last(), "id"))
    return spans_of(t).select("id", "artifact_id", rank.alias("rank")).withColumn("score", F.round(1 - 0.05 * (F.col("rank") - 1), 6))


_BAG = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@query(f"""{WITH}, w AS (SELECT id, artifact_id, start_line, end_line, {_BAG.format('text')} AS bag FROM sp WHERE text IS NOT NULL)
SELECT a.id, b.id AS other, round(CASE WHEN len(list_distinct(list_concat(a.bag, b.bag))) > 0 THEN len(list_intersect(a.bag, b.bag)) / len(list_distinct(list_concat(a.bag, b.bag))) ELSE 0 END, 6) AS jaccard FROM w a JOIN w b ON b.artifact_id = a.artifact_id AND b.start_line = a.end_line + 1""")
def jaccard_neighbours(t):
    rows = spans_of(t).filter("text is not null").withColumn("bag", T.words(F.col("text")))
    a = rows.select("artifact_id", "id", F.col("bag").alias("x"), (F.col("end_line") + 1).alias("line"))
    b = rows.select("artifact_id", F.col("id").alias("other"), F.col("bag").alias("y"), F.col("start_line").alias("line"))
    return a.join(b, ["artifact_id", "line"]).select("id", "other", F.round(T.jaccard_words(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("""SELECT o_orderkey, CASE WHEN size < 1000 THEN 'all-MiniLM-L6-v2 (default)' WHEN size > 10000 AND uc = 'production' THEN 'nomic-embed-text-v1.5' WHEN uc IN ('legal', 'compliance') THEN 'bge-large-en-v1.5' WHEN uc IN ('code', 'code-search') THEN 'all-MiniLM-L6-v2 (default)'
WHEN size <= 10000 THEN 'nomic-embed-text-v1.5' ELSE 'all-MiniLM-L6-v2 (default)' END AS model FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS size, CASE o_orderkey % 5 WHEN 0 THEN 'production' WHEN 1 THEN 'legal' WHEN 2 THEN 'code' WHEN 3 THEN 'chat' END AS uc FROM orders)""")
def recommend_model(t):
    use = F.when(F.col("o_orderkey") % 5 == 0, "production").when(F.col("o_orderkey") % 5 == 1, "legal").when(F.col("o_orderkey") % 5 == 2, "code").when(F.col("o_orderkey") % 5 == 3, "chat")
    rows = t("orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 10).alias("size"), use.alias("uc"))
    return rows.select("o_orderkey", labels.recommend_model(F.col("size"), F.col("uc")).alias("model"))


@query("""SELECT event_id, CASE WHEN s < 2 AND r > 1000 THEN 'Excellent' WHEN s < 5 AND r > 500 THEN 'Good' WHEN s < 10 AND r > 200 THEN 'Fair' ELSE 'Needs Optimization' END AS rating FROM (SELECT event_id, abs(value) / 10 AS s, 100.0::DOUBLE / (abs(value) * 3 + 1) * 1000 AS r FROM events)""")
def hardware_rating(t):
    v = F.abs("value")
    return t("events").select("event_id", labels.hardware_rating(v / 10, v * 3 + 1).alias("rating"))


# ---- retrieval, selection, compilation ------------------------------------------------------------
_SEM = f""", qv AS (SELECT query_id, {_HASHED} AS v FROM req), sm AS (SELECT q.query_id, s.id, s.artifact_id, s.start_line, CASE WHEN list_sum(list_transform(CAST(s.embedding AS DOUBLE[]), lambda x: x * x)) > 0 THEN round({_COS.format(a='q.v', b='s.embedding')}, 9) ELSE 0 END AS score FROM qv q, (SELECT * FROM spv WHERE {_OK}) s),
sem AS (SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, artifact_id, start_line NULLS LAST, id) AS INT) AS rank FROM sm) WHERE rank <= 50)"""
_FUSED = _SEM + _LEXTOP + """, fu AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, 0.7::DOUBLE / (60 + rank - 1) AS part FROM sem UNION ALL SELECT query_id, id, 0.3::DOUBLE / (60 + rank - 1) FROM lex) GROUP BY 1, 2),
fused AS (SELECT f.*, s.artifact_id, s.start_line, CAST(greatest(coalesce(s.token_count, 0), 0) AS BIGINT) AS tokens, q.budget, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, s.artifact_id, s.start_line NULLS LAST, f.id) AS INT) AS rank FROM fu f JOIN sp s ON s.id = f.id JOIN req q ON q.query_id = f.query_id)"""


def compiler_of(t, **options) -> Compiler:
    return Compiler(t("spans"), t("artifacts"), Config(**options))


@query(WITH + _SEM + " SELECT query_id, id, round(score, 6) AS score, rank FROM sem")
def semantic_search(t):
    return compiler_of(t).stages(requests_of(t), "semantic")["semantic"].withColumn("score", F.round("score", 6)).select("query_id", "id", "score", "rank")


@query(WITH + _FUSED + " SELECT query_id, id, round(score, 9) AS score, rank FROM fused")
def rrf_fusion(t):
    return compiler_of(t).stages(requests_of(t), "hybrid")["hybrid"].withColumn("score", F.round("score", 9))


_FINITE = "len({0}) = 64 AND NOT coalesce(list_contains(list_transform({0}, lambda e: isfinite(e)), false), false)"
_PAIR = "CASE WHEN list_sum(list_transform(x, lambda e: e * e)) > 0 AND list_sum(list_transform(y, lambda e: e * e)) > 0 THEN list_cosine_similarity(x, y) WHEN x IS NOT NULL AND y IS NOT NULL THEN 0 END"


def _mmr(source: str = "fused") -> str:
    """Diversity re-ranking as a recursion: a row a query and step, with the places taken and each
    candidate's greatest similarity to them."""
    return f""", mv AS (SELECT f.query_id, f.id, f.score, f.rank, CASE WHEN {_FINITE.format('s.embedding')} THEN CAST(s.embedding AS DOUBLE[]) END AS v FROM {source} f JOIN (SELECT id, min(embedding) AS embedding FROM spv GROUP BY 1) s ON s.id = f.id),
ml AS (SELECT query_id, list(id ORDER BY rank) AS ids, list(score ORDER BY rank) AS s, list(v ORDER BY rank) AS v, count(*) AS n FROM mv GROUP BY 1),
mg AS (SELECT query_id, ids, s, n, list_transform(v, lambda x: list_transform(v, lambda y: {_PAIR})) AS g FROM ml),
mr AS (SELECT query_id, 1 AS k, [CAST(1 AS BIGINT)] AS taken, g[1] AS close FROM mg
 UNION ALL SELECT query_id, k + 1, list_append(taken, i), list_transform(range(1, n + 1), lambda j: greatest(close[j], g[i][j])) FROM (SELECT r.query_id, r.k, r.taken, r.close, m.n, m.g,
 list_position(w, list_max(w)) AS i FROM (SELECT r.*, list_transform(range(1, m.n + 1), lambda j: CASE WHEN list_contains(r.taken, j) THEN '-inf'::DOUBLE ELSE round(0.5::DOUBLE * m.s[j] - 0.5::DOUBLE * coalesce(r.close[j], 0), 12) END) AS w
 FROM mr r JOIN mg m USING (query_id) WHERE r.k < least(m.n, 30)) r JOIN mg m USING (query_id))),
mt AS (SELECT query_id, taken FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC) AS late FROM mr) WHERE late = 1),
mmr AS (SELECT t.query_id, m.ids[u.i] AS id, m.s[u.i] AS score, CAST(u.k AS INT) AS rank FROM (SELECT query_id, unnest(taken) AS i, unnest(range(1, len(taken) + 1)) AS k FROM mt) u JOIN mt t USING (query_id) JOIN mg m USING (query_id))"""


def _sized(source: str, budget: str = "q.budget") -> str:
    return f""", sized AS (SELECT m.*, CAST(greatest(coalesce(s.token_count, 0), 0) AS BIGINT) AS tokens, CAST({budget} AS BIGINT) AS budget FROM {source} m JOIN sp s ON s.id = m.id JOIN req q ON q.query_id = m.query_id)"""


@query(WITH + _FUSED + _mmr() + " SELECT query_id, id, round(score, 9) AS score, rank FROM mmr")
def mmr_select(t):
    return compiler_of(t).stages(requests_of(t), "mmr")["mmr"].select("query_id", "id", F.round("score", 9).alias("score"), "rank")


_COMPILED = WITH + _FUSED + _packed(source="fused") + _cited()
_OUT = f", sets AS (SELECT q.query_id, q.budget, coalesce(c.text, '') AS text, coalesce(c.n, 0) AS n_spans FROM req q LEFT JOIN (SELECT query_id, string_agg({BLOCK}, {GAP} ORDER BY citation) AS text, count(*) AS n FROM cited GROUP BY 1) c USING (query_id))"


@query(_COMPILED + _OUT + " SELECT query_id, CAST(n_spans AS INT) AS n_spans, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens_used, sha256(text) AS context_hash FROM sets")
def compile_context(t):
    return compiler_of(t, enable_mmr=False).compile(requests_of(t)).select("query_id", "n_spans", "tokens_used", "context_hash")


_MMR_COMPILED = WITH + _FUSED + _mmr() + _sized("mmr") + _packed(source="sized") + _cited()


@query(_MMR_COMPILED + _OUT + " SELECT query_id, CAST(n_spans AS INT) AS n_spans, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens_used, sha256(text) AS context_hash FROM sets")
def compile_context_mmr(t):
    return compiler_of(t).compile(requests_of(t)).select("query_id", "n_spans", "tokens_used", "context_hash")


@query(_COMPILED + """, stages AS (SELECT query_id, 'semantic' AS stage, rank, id, score FROM sem UNION ALL SELECT query_id, 'lexical', rank, id, NULL FROM lex UNION ALL SELECT query_id, 'hybrid', rank, id, score FROM fused
UNION ALL SELECT query_id, 'packed', rank, id, score FROM packed UNION ALL SELECT query_id, 'final', CAST(citation AS INT), id, score FROM cited)
SELECT t.query_id, t.stage, t.rank, t.id, coalesce(a.path, 'unknown') AS path, round(t.score, 6) AS score, CAST(greatest(coalesce(s.token_count, 0), 0) AS BIGINT) AS tokens FROM stages t JOIN sp s ON s.id = t.id LEFT JOIN art a ON a.id = s.artifact_id""")
def explain_stages(t):
    return compiler_of(t, enable_mmr=False).explain(requests_of(t)).select("query_id", "stage", "rank", "id", "path", F.round("score", 6).alias("score"), "tokens")


@query(_COMPILED + """ SELECT query_id, stage, count(*) AS n FROM (SELECT query_id, 'semantic' AS stage FROM sem UNION ALL SELECT query_id, 'lexical' FROM lex UNION ALL SELECT query_id, 'hybrid' FROM fused UNION ALL SELECT query_id, 'packed' FROM packed UNION ALL SELECT query_id, 'final' FROM cited) GROUP BY 1, 2""")
def stage_counts(t):
    return compiler_of(t, enable_mmr=False).explain(requests_of(t)).groupBy("query_id", "stage").agg(F.count("*").alias("n"))


_PGSETS = WITH + _SEM + """, cand AS (SELECT m.query_id, m.id, m.rank, m.score, CAST(greatest(coalesce(s.token_count, 0), 0) AS BIGINT) AS tokens, q.budget FROM sem m JOIN sp s ON s.id = m.id JOIN req q ON q.query_id = m.query_id)""" + _packed(pg=True) + _cited("path")


@query(_PGSETS + f" SELECT q.query_id, coalesce(c.n, 0) AS n_spans, coalesce(c.used, 0) AS tokens_used, left(sha256(coalesce(c.text, '')), 24) AS context_hash FROM req q LEFT JOIN (SELECT query_id, CAST(count(*) AS INT) AS n, CAST(sum(tokens) AS BIGINT) AS used, string_agg({BLOCK_PG}, {GAP_PG} ORDER BY citation) AS text FROM cited GROUP BY 1) c USING (query_id)")
def pg_compile_plain(t):
    return compiler_of(t, profile="pg", enable_mmr=False).compile(requests_of(t)).select("query_id", "n_spans", "tokens_used", "context_hash")


_PG_MMR = f""", wv AS (SELECT m.query_id, m.id, m.score, m.rank, {_BAG.format("coalesce(s.text, '')")} AS bag, coalesce(a.path, 'unknown') || chr(1) || coalesce(CAST(s.start_line // 10 AS VARCHAR), '') AS spot FROM sem m JOIN sp s ON s.id = m.id LEFT JOIN art a ON a.id = s.artifact_id),
wl AS (SELECT query_id, list(id ORDER BY rank) AS ids, list(score ORDER BY rank) AS s, list(bag ORDER BY rank) AS b, list(spot ORDER BY rank) AS spots, count(*) AS n FROM wv GROUP BY 1),
wg AS (SELECT query_id, ids, s, spots, n, list_transform(b, lambda x: list_transform(b, lambda y: CASE WHEN len(x) + len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0 END)) AS g FROM wl),
wr AS (SELECT query_id, 0 AS k, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS taken, list_transform(s, lambda x: 0::DOUBLE) AS close FROM wg
 UNION ALL SELECT query_id, k + 1, list_append(seen, i), CASE WHEN fresh THEN list_append(taken, i) ELSE taken END, CASE WHEN fresh THEN list_transform(range(1, n + 1), lambda j: greatest(close[j], g[i][j])) ELSE close END
 FROM (SELECT r.*, m.n, m.g, NOT list_contains(list_transform(r.taken, lambda j: m.spots[j]), m.spots[r.i]) AS fresh FROM (SELECT r.*, list_position(w, list_max(w)) AS i FROM (SELECT r.*, list_transform(range(1, m.n + 1), lambda j: CASE WHEN list_contains(r.seen, j) THEN '-inf'::DOUBLE ELSE round(0.5::DOUBLE * m.s[j] - 0.5::DOUBLE * r.close[j], 12) END) AS w
 FROM wr r JOIN wg m USING (query_id) WHERE r.k < m.n AND len(r.taken) < 20) r) r JOIN wg m USING (query_id))),
wt AS (SELECT query_id, taken FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC) AS late FROM wr) WHERE late = 1),
cand AS (SELECT u.query_id, m.ids[u.i] AS id, CAST(u.k AS INT) AS rank, m.s[u.i] AS score, CAST(greatest(coalesce(s.token_count, 0), 0) AS BIGINT) AS tokens, q.budget FROM (SELECT query_id, unnest(taken) AS i, unnest(range(1, len(taken) + 1)) AS k FROM wt) u JOIN wg m USING (query_id) JOIN sp s ON s.id = m.ids[u.i] JOIN req q ON q.query_id = u.query_id)"""
_PG_OUT = f" SELECT q.query_id, coalesce(c.n, 0) AS n_spans, coalesce(c.used, 0) AS tokens_used, left(sha256(coalesce(c.text, '')), 24) AS context_hash FROM req q LEFT JOIN (SELECT query_id, CAST(count(*) AS INT) AS n, CAST(sum(tokens) AS BIGINT) AS used, string_agg({BLOCK_PG}, {GAP_PG} ORDER BY citation) AS text FROM cited GROUP BY 1) c USING (query_id)"


@query(WITH + _SEM + _PG_MMR + _packed(pg=True) + _cited("path") + _PG_OUT)
def pg_compile(t):
    return compiler_of(t, profile="pg").compile(requests_of(t)).select("query_id", "n_spans", "tokens_used", "context_hash")


@query(WITH + _cand() + _packed() + " SELECT query_id, id FROM packed")
def pack_budget(t):
    return selection.pack(candidates_of(t))


@query(WITH + _cand() + _packed(pg=True) + " SELECT query_id, id FROM packed")
def pack_budget_pg(t):
    return selection.pack_in_order(candidates_of(t))


BUDGETS = (2000, 4000, 8000, 16000)


@query(WITH + "".join(_cand(str(b)).replace("cand AS", f"cand{b} AS") + _packed(source=f"cand{b}", suffix=str(b)) for b in BUDGETS) + " " + " UNION ALL ".join(f"SELECT query_id, CAST({b} AS BIGINT) AS budget, count(*) AS spans, CAST(sum(tokens) AS BIGINT) AS used, CAST(floor(sum(tokens) * 100 / {b}) AS BIGINT) AS utilisation FROM packed{b} GROUP BY 1" for b in BUDGETS))
def budget_sweep(t):
    rows = candidates_of(t).drop("budget").withColumn("budget", F.explode(F.array(*(F.lit(b).cast("long") for b in BUDGETS))))
    keyed = rows.withColumn("query_id", F.struct("query_id", "budget"))
    used = keyed.select("query_id", "id", "tokens").join(selection.pack(keyed), ["query_id", "id"])
    out = used.groupBy("query_id").agg(F.count("*").alias("spans"), F.sum("tokens").alias("used"))
    return out.select("query_id.query_id", "query_id.budget", "spans", "used", labels.utilisation(F.col("used"), F.col("query_id.budget")).alias("utilisation"))


@query(SETS + " SELECT query_id, CAST(n_spans AS INT) AS n_spans, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens_used, sha256(text) AS context_hash, CASE WHEN budget > 0 THEN CAST(floor(CAST(ceil(strlen(text) / 4) AS BIGINT) * 100 / budget) AS BIGINT) ELSE 0 END AS utilisation FROM sets")
def context_hash(t):
    return context.working_sets(cited_of(t), requests_of(t)).select("query_id", "n_spans", "tokens_used", "context_hash", "utilisation")


@query(CITED + " SELECT query_id, CAST(citation AS INT) AS citation, id, path, start_line, end_line FROM cited")
def citations(t):
    return cited_of(t).select("query_id", "citation", "id", "path", "start_line", "end_line")


@query(SETS + """ SELECT s.query_id, 'cl100k_base' AS tokenizer, CAST(32 AS INT) AS m, CAST(20 AS INT) AS min_lines, sha256(s.text) AS context_hash, coalesce(f.model, 'all-MiniLM-L6-v2') AS embedding_model, coalesce(f.dim, 384) AS embedding_dimension
FROM sets s LEFT JOIN (SELECT c.query_id, min(v.model) AS model, min(CAST(len(v.embedding) AS INT)) AS dim FROM cited c JOIN spv v ON v.id = c.id WHERE c.citation = 1 GROUP BY 1) f USING (query_id)""")
def manifest(t):
    m = context.manifest(context.working_sets(cited_of(t), requests_of(t)), spans_of(t, True))
    return m.select("query_id", *(f"manifest.{c}" for c in ("tokenizer", "index.m", "chunking.min_lines", "context_hash", "embedding_model", "embedding_dimension")))


# ---- sessions -------------------------------------------------------------------------------------
@query(f"{WITH} SELECT session_id, id, position FROM num")
def message_sequence(t):
    return S.numbered(messages_of(t)).select("session_id", "id", "position")


@query(f"""{WITH}, late AS (SELECT * FROM msg WHERE sequence_number IS NULL AND session_id IS NOT NULL), top AS (SELECT session_id, max(sequence_number) AS top FROM msg WHERE sequence_number IS NOT NULL GROUP BY 1)
SELECT l.id, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY l.session_id ORDER BY created_at NULLS LAST, l.id) AS INT) AS sequence_number FROM late l LEFT JOIN top USING (session_id)""")
def appended_numbers(t):
    rows = messages_of(t).filter("session_id is not null")
    return S.appended_numbers(rows.filter("sequence_number is not null"), rows.filter("sequence_number is null")).select("id", "sequence_number")


@query(f"{WITH} SELECT session_id, id, position FROM num WHERE position < 10")
def oldest_messages(t):
    return S.oldest_messages(messages_of(t), 10).select("session_id", "id", "position")


@query(f"{WITH} SELECT user_id, id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, id) AS rank FROM ses WHERE user_id IS NOT NULL) WHERE rank <= 20")
def recent_sessions_by_user(t):
    return S.recent_sessions(t("sessions").distinct(), 20, per_user=True).select("user_id", "id", "rank")


@query(f"{WITH} SELECT id FROM ses ORDER BY updated_at DESC NULLS LAST, id LIMIT 100")
def recent_sessions(t):
    return S.recent_sessions(t("sessions").distinct(), 100).select("id")


_RUN = ", run AS (SELECT *, sum(coalesce(CAST(ceil(strlen(content) / 4) AS BIGINT), 0)) OVER (PARTITION BY session_id ORDER BY position DESC ROWS UNBOUNDED PRECEDING) AS running FROM num)"


@query(f"{WITH}{_RUN} SELECT session_id, id, CAST(running AS BIGINT) AS running FROM run WHERE running <= 100")
def history_window(t):
    return S.history_window(messages_of(t), 100).select("session_id", "id", "running")


_ROLE = "coalesce(trim(lower(role)), 'unknown')"


@query(f"{WITH} SELECT session_id, sha256(string_agg(upper(left({_ROLE}, 1)) || substr({_ROLE}, 2) || ': ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY position)) AS history FROM num GROUP BY 1")
def conversation_history(t):
    return S.conversation_history(messages_of(t)).withColumn("history", F.sha2("history", 256))


@query(f"{WITH}{_RUN} SELECT session_id, sha256(string_agg(upper(left({_ROLE}, 1)) || substr({_ROLE}, 2) || ': ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY position)) AS history FROM run WHERE running <= 100 GROUP BY 1")
def limited_history(t):
    return S.conversation_history(messages_of(t), 100).withColumn("history", F.sha2("history", 256))


@query(f"{WITH} SELECT session_id, sha256(string_agg(trim(upper({_ROLE}) || ': ' || coalesce(content, ''), ' '), chr(10) || chr(10) ORDER BY position)) AS history FROM num GROUP BY 1")
def history_pg(t):
    return S.conversation_history(messages_of(t), upper=True).withColumn("history", F.sha2("history", 256))


_TURNS = """, nx AS (SELECT *, trim(lower(role)) AS r, lead(trim(lower(role))) OVER w AS nr, lead(id) OVER w AS nid, lead(content) OVER w AS nc FROM num WINDOW w AS (PARTITION BY session_id ORDER BY position)),
turns AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS turn, id AS user_message_id, content AS query, CASE WHEN nr = 'assistant' THEN nid END AS assistant_message_id, CASE WHEN nr = 'assistant' THEN nc END AS answer FROM nx WHERE r = 'user')"""


@query(f"{WITH}{_TURNS} SELECT session_id, turn, user_message_id, assistant_message_id FROM turns")
def replay_turns(t):
    return S.replay(messages_of(t)).select("session_id", "turn", "user_message_id", "assistant_message_id")


_WS = "ws AS (SELECT c.id, c.created_at, m.id AS message_id FROM (SELECT DISTINCT * FROM compile_requests) c JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n FROM num WHERE trim(lower(role)) = 'user') m ON m.n = CAST('0x' || left(md5(c.id), 7) AS BIGINT) % (SELECT count(*) FROM num WHERE trim(lower(role)) = 'user') + 1)"


def _working_sets(t) -> DataFrame:
    """Requests as the working sets of user messages, dealt by hash: the data has no such link."""
    asked = S.numbered(messages_of(t)).filter(F.trim(F.lower("role")) == "user").select("id")
    n = asked.count()
    ranked = asked.withColumn("n", F.row_number().over(W.orderBy("id")))
    at = F.conv(F.left(F.md5("id"), F.lit(7)), 16, 10).cast("long") % n + 1
    return t("compile_requests").distinct().select("id", "created_at", at.alias("n")).join(ranked.withColumnRenamed("id", "message_id"), "n").drop("n")


@query(f"{WITH}{_TURNS}, {_WS}, newest AS (SELECT message_id, max_by(id, (created_at, id)) AS working_set_id FROM ws GROUP BY 1) SELECT t.session_id, t.turn, n.working_set_id FROM turns t JOIN newest n ON n.message_id = t.user_message_id")
def replay_working_sets(t):
    return S.replay(messages_of(t), _working_sets(t)).filter("working_set_id is not null").select("session_id", "turn", "working_set_id")


_AN = _TURNS + ", an AS (SELECT session_id, count(*) AS turns, CAST(sum(coalesce(CAST(ceil(strlen(answer) / 4) AS BIGINT), 0)) AS BIGINT) AS total_tokens FROM turns GROUP BY 1)"


@query(f"{WITH}{_AN} SELECT *, round(total_tokens / turns, 6) AS avg_tokens FROM an")
def session_analytics(t):
    return S.session_analytics(messages_of(t))


@query(f"{WITH}{_AN}, ow AS (SELECT id AS session_id, user_id, created_at AS began FROM ses WHERE user_id IS NOT NULL), st AS (SELECT user_id, count(*) AS sessions, CAST(coalesce(sum(turns), 0) AS BIGINT) AS turns, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM ow LEFT JOIN an USING (session_id) GROUP BY 1),"
       " asked AS (SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY began DESC NULLS LAST, session_id DESC, turn DESC) AS late FROM ow JOIN turns USING (session_id)), rc AS (SELECT user_id, string_agg(coalesce(left(query, 60), ''), ' | ' ORDER BY late DESC) AS recent FROM asked WHERE late <= 5 GROUP BY 1)"
       " SELECT user_id, sessions, turns, tokens, round(turns / sessions, 6) AS avg_turns, CASE WHEN turns > 0 THEN round(tokens / turns, 6) ELSE 0 END AS avg_tokens, coalesce(recent, '') AS recent FROM st LEFT JOIN rc USING (user_id)")  # fmt: skip
def user_report(t):
    return S.user_report(t("sessions").distinct(), messages_of(t))


@query(f"{WITH} SELECT id FROM ses WHERE id NOT IN (SELECT session_id FROM msg WHERE session_id IS NOT NULL AND trim(lower(role)) = 'user')")
def empty_sessions(t):
    return S.empty_sessions(t("sessions").distinct(), messages_of(t)).select("id")


@query(f"{WITH} SELECT s.id, epoch_us(m.last) AS last_message, coalesce(m.n, 0) AS n_messages, (s.last_message_at IS NOT DISTINCT FROM m.last) AS up_to_date FROM ses s LEFT JOIN (SELECT session_id, max(created_at) AS last, count(*) AS n FROM msg GROUP BY 1) m ON m.session_id = s.id")
def last_messages(t):
    s = t("sessions").distinct()
    return S.touched(s, messages_of(t)).join(s.select("id", F.col("last_message_at").alias("stored")), "id").select(
        "id", F.unix_micros("last_message_at").alias("last_message"), "n_messages", F.col("stored").eqNullSafe(F.col("last_message_at")).alias("up_to_date")
    )


@query(f"{WITH} SELECT s.id, coalesce(n.title, s.title) AS title, s.metadata FROM ses s LEFT JOIN (SELECT session_id AS id, left(max_by(content, position), 40) AS title FROM num WHERE content IS NOT NULL AND trim(lower(role)) = 'user' GROUP BY 1) n ON n.id = s.id")
def update_sessions(t):
    last = S.numbered(messages_of(t)).filter((F.trim(F.lower("role")) == "user") & F.col("content").isNotNull()).groupBy(F.col("session_id").alias("id")).agg(F.left(F.max_by("content", "position"), F.lit(40)).alias("title"))
    return S.update_sessions(t("sessions").distinct(), last.withColumn("metadata", F.lit(None).cast("string"))).select("id", "title", "metadata")


@query(f"{WITH}, d AS (SELECT id FROM ses WHERE user_id IS NULL) SELECT 'sessions' AS name, count(*) AS n FROM ses WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT 'messages', count(*) FROM msg WHERE session_id IS NULL OR session_id NOT IN (SELECT id FROM d)")
def cascade_delete(t):
    s = t("sessions").distinct()
    left = S.delete_sessions({"sessions": s, "messages": messages_of(t)}, s.filter("user_id is null").select("id"))
    return files.union_all([df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()])


@query(f"{WITH} SELECT s.id, s.title, coalesce(m.n, 0) AS n_messages, m.ids FROM ses s LEFT JOIN (SELECT session_id, CAST(count(*) AS INT) AS n, string_agg(id, ',' ORDER BY position) AS ids FROM num GROUP BY 1) m ON m.session_id = s.id")
def session_full(t):
    full = S.session_full(t("sessions").distinct(), messages_of(t))
    return full.select("id", "title", "n_messages", F.array_join(F.transform("messages", lambda m: m["message_id"]), ",").alias("ids"))


@query(f"{WITH} SELECT coalesce(role, '') AS role, coalesce(role IN ('user', 'assistant', 'system', 'tool'), false) AS valid, count(*) AS n FROM msg GROUP BY 1, 2")
def role_validation(t):
    rows = messages_of(t).select(F.coalesce("role", F.lit("")).alias("role"), labels.valid_role(F.col("role")).alias("valid"))
    return rows.groupBy("role", "valid").agg(F.count("*").alias("n"))


@query(f"{WITH}{_TURNS} SELECT session_id, CAST(sum(k) AS BIGINT) AS total, round(avg(k), 6) AS mean, min(k) AS lowest, max(k) AS highest FROM (SELECT session_id, coalesce(CAST(ceil(strlen(answer) / 4) AS BIGINT), 0) AS k FROM turns) GROUP BY 1")
def token_usage(t):
    k = F.coalesce(T.estimate_tokens(F.col("answer")), F.lit(0))
    return S.replay(messages_of(t)).groupBy("session_id").agg(F.sum(k).alias("total"), F.round(F.avg(k), 6).alias("mean"), F.min(k).alias("lowest"), F.max(k).alias("highest"))


# ---- agents ---------------------------------------------------------------------------------------
_AG = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.agent_id') END"
_STANCE = "CASE position % 4 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' WHEN 2 THEN 'neutral' ELSE 'question' END"
_REL = f""", rl AS (SELECT *, {_AG} AS agent, lag(id) OVER w AS target, lag({_AG}) OVER w AS to_agent FROM num WINDOW w AS (PARTITION BY session_id ORDER BY position)),
rel AS (SELECT sha256(id || '|' || target) AS id, session_id, id AS message_id, agent AS from_agent_id, coalesce(to_agent, 'unknown') AS to_agent_id, {_STANCE} AS stance, target AS target_message_id, created_at FROM rl WHERE agent IS NOT NULL AND target IS NOT NULL),
named AS (SELECT r.*, coalesce(a.name, 'unknown') AS from_name, coalesce(a.model, '?') AS from_model, coalesce(b.name, 'unknown') AS to_name, coalesce(b.model, '?') AS to_model FROM rel r LEFT JOIN agents a ON a.id = r.from_agent_id LEFT JOIN agents b ON b.id = r.to_agent_id)"""


def relations_of(t) -> DataFrame:
    p = F.col("position") % 4  # the data has no stances
    return A.relations(messages_of(t), F.when(p == 0, "agree").when(p == 1, "disagree").when(p == 2, "neutral").otherwise("question"))


@query(f"{WITH}{_REL} SELECT id, message_id, from_name, from_model, to_name, to_model, stance FROM named")
def agent_relations(t):
    return A.named_relations(relations_of(t), t("agents")).select("id", "message_id", "from_name", "from_model", "to_name", "to_model", "stance")


_LIST = "coalesce(string_agg(CASE WHEN stance = '{}' THEN from_name || '(' || from_model || ')>' || to_name END, ';' ORDER BY created_at NULLS FIRST, message_id), '') AS {}"


@query(f"{WITH}{_REL} SELECT session_id, {_LIST.format('agree', 'agreements')}, {_LIST.format('disagree', 'disagreements')}, {_LIST.format('question', 'questions')} FROM named GROUP BY 1")
def relation_summary(t):
    return A.summary(relations_of(t), t("agents"))


@query(f"{WITH}{_REL} SELECT session_id, {_LIST.format('agree', 'agreements')}, {_LIST.format('disagree', 'disagreements')}, {_LIST.format('question', 'questions')}, {_LIST.format('neutral', 'neutrals')} FROM named GROUP BY 1")
def relation_summary_pg(t):
    return A.summary(relations_of(t), t("agents"), neutrals=True)


@query(f"{WITH} SELECT DISTINCT m.session_id, a.id AS agent_id, a.name FROM msg m JOIN agents a ON a.id = {_AG.replace('metadata', 'm.metadata')} WHERE m.session_id IS NOT NULL")
def session_agents(t):
    return A.session_agents(messages_of(t), t("agents"))


@query("SELECT id, name, CAST(coalesce(len(capabilities), 0) AS INT) AS n_capabilities, array_to_string(list_sort(capabilities), ',') AS capabilities FROM agents")
def agent_list(t):
    return t("agents").select("id", "name", F.coalesce(F.size("capabilities"), F.lit(0)).alias("n_capabilities"), F.array_join(F.array_sort("capabilities"), ",").alias("capabilities"))


@query("SELECT id, name, CASE WHEN role IS NOT NULL AND did IS NULL THEN 'new' ELSE model END AS model FROM agents")
def agent_upsert(t):
    changes = t("agents").filter("role is not null and did is null").withColumn("model", F.lit("new"))
    return A.upsert_agents(t("agents"), changes).select("id", "name", "model")


# ---- audit ----------------------------------------------------------------------------------------
_TWO = WITH + _cand("4000") + _packed() + _cited() + _cand("8000").replace("cand AS", "cand8 AS") + _packed(source="cand8", suffix="8") + _cited(suffix="8")
_DIFF = _TWO + """, df AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.citation <> b.citation OR abs(a.score - b.score) > 0.001 THEN 'reranked' END AS change, CAST(a.citation AS INT) AS old_rank, CAST(b.citation AS INT) AS new_rank
FROM cited a FULL JOIN cited8 b ON a.query_id = b.query_id AND a.id = b.id)"""


def _two(t) -> tuple[DataFrame, DataFrame]:
    return tuple(cited_of(t, b).withColumnRenamed("citation", "rank") for b in (4000, 8000))


@query(_DIFF + " SELECT * FROM df WHERE change IS NOT NULL")
def ws_diff(t):
    return audit.diff(*_two(t)).select("query_id", "id", "change", "old_rank", "new_rank")


@query(_DIFF + """ SELECT q.query_id, CASE WHEN coalesce(a, 0) + coalesce(r, 0) + coalesce(k, 0) = 0 THEN 'No changes' ELSE concat_ws(', ', CASE WHEN a > 0 THEN a || ' added' END, CASE WHEN r > 0 THEN r || ' removed' END, CASE WHEN k > 0 THEN k || ' reranked' END) END AS summary
FROM req q LEFT JOIN (SELECT query_id, count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'reranked') AS k FROM df GROUP BY 1) c USING (query_id)""")
def diff_summary(t):
    return audit.diff_summary(audit.diff(*_two(t)), requests_of(t))


@query(_TWO + f""", a AS (SELECT query_id, string_agg({BLOCK}, {GAP} ORDER BY citation) AS x FROM cited GROUP BY 1), b AS (SELECT query_id, string_agg({BLOCK}, {GAP} ORDER BY citation) AS y FROM cited8 GROUP BY 1)
SELECT q.query_id, coalesce(x, '') = coalesce(y, '') AS same FROM req q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""")
def ws_identical(t):
    r = requests_of(t)
    return audit.identical(context.working_sets(cited_of(t, 4000), r), context.working_sets(cited_of(t, 8000), r))


_GOLD = CITED + """, gold AS (SELECT q.query_id, coalesce(e.expected, []) AS expected, coalesce(r.results, []) AS results FROM req q LEFT JOIN (SELECT c.query_id, list(coalesce(a.path, 'unknown') ORDER BY c.rank, c.id) AS expected FROM cand c JOIN sp s ON s.id = c.id LEFT JOIN art a ON a.id = s.artifact_id WHERE c.rank <= 3 GROUP BY 1) e USING (query_id)
LEFT JOIN (SELECT query_id, list(path ORDER BY citation) AS results FROM cited GROUP BY 1) r USING (query_id)),
ev AS (SELECT query_id, CASE WHEN len(list_distinct(expected)) = 0 THEN 1 ELSE len(list_intersect(list_distinct(expected), results[:10])) / len(list_distinct(expected)) END AS recall, CASE WHEN len(results[:10]) = 0 THEN 0 ELSE len(list_intersect(list_distinct(expected), results[:10])) / len(results[:10]) END AS precision,
coalesce(1 / list_min(list_filter(list_transform(expected, lambda p: list_position(results, p)), lambda i: i > 0)), 0) AS mrr FROM gold)"""


def golden_of(t) -> DataFrame:
    """The paths of each request's three best candidates as the expected ones, and what was compiled."""
    paths = artifacts_of(t).select(F.col("id").alias("artifact_id"), "path")
    best = candidates_of(t).filter("rank <= 3").join(spans_of(t).select("id", "artifact_id"), "id").join(paths, "artifact_id", "left")
    expected = best.groupBy("query_id").agg(F.collect_list(F.coalesce("path", F.lit("unknown"))).alias("expected"))
    results = cited_of(t).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("citation", "path"))), lambda c: c["path"]).alias("results"))
    none = F.array().cast("array<string>")
    out = requests_of(t).select("query_id").join(expected, "query_id", "left").join(results, "query_id", "left")
    return out.select("query_id", F.coalesce("expected", none).alias("expected"), F.coalesce("results", none).alias("results"), F.lit(10).alias("k"))


@query(_GOLD + " SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr FROM ev")
def eval_metrics(t):
    return audit.evaluate(golden_of(t)).select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")))


@query(_GOLD + " SELECT count(*) AS queries, round(avg(recall), 4) AS mean_recall, round(avg(precision), 4) AS mean_precision, round(avg(mrr), 4) AS mean_mrr FROM ev")
def eval_summary(t):
    out = audit.evaluation_summary(audit.evaluate(golden_of(t)))
    return out.select("queries", *(F.round(c, 4).alias(c) for c in ("mean_recall", "mean_precision", "mean_mrr")))


@query(f"{WITH}, o AS (SELECT token_count AS v, row_number() OVER (ORDER BY token_count) - 1 AS i, count(*) OVER () AS n FROM sp WHERE token_count IS NOT NULL) SELECT CAST(max(CASE WHEN i = n // 2 THEN v END) AS INT) AS p50, CAST(max(CASE WHEN i = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1) THEN v END) AS INT) AS p99 FROM o")
def token_quantiles(t):
    return audit.order_statistics(spans_of(t).filter("token_count is not null").groupBy(F.col("token_count").alias("v")).agg(F.count("*").alias("c")))


@query(CITED + """ SELECT q.query_id, round(CASE WHEN len(w) = 0 THEN 1 ELSE len(list_filter(w, lambda x: contains(lower(t), x))) / len(w) END, 6) AS term_recall FROM (SELECT query_id, list_filter(string_split(lower(coalesce(query, '')), ' '), lambda x: x <> '') AS w FROM req) q
JOIN (SELECT r.query_id, coalesce(string_agg(text, chr(10) ORDER BY citation), '') AS t FROM req r LEFT JOIN cited c USING (query_id) GROUP BY 1) c USING (query_id)""")
def term_recall(t):
    terms = F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), " "), lambda w: w != "")
    texts = cited_of(t).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", "text"))), lambda c: c["text"]), "\n").alias("t"))
    rows = requests_of(t).join(texts, "query_id", "left")
    return rows.select("query_id", F.round(audit.term_recall(terms, F.coalesce("t", F.lit(""))), 6).alias("term_recall"))


@query(CITED + " SELECT *, avg_score < 0.5 AS low_score, sources < 3 AS few_sources FROM (SELECT query_id, count(*) AS spans, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 9) AS avg_score, count(DISTINCT path) AS sources FROM cited GROUP BY 1)")
def context_quality(t):
    out = audit.context_quality(cited_of(t))
    return out.select("query_id", "spans", *(F.round(c, 6).alias(c) for c in ("min_score", "max_score")), "avg_score", "sources", "low_score", "few_sources")


# ---- adapters -------------------------------------------------------------------------------------
_MERGED = CITED + """, fl AS (SELECT *, CASE WHEN path = lag(path) OVER w AND start_line - lag(end_line) OVER w BETWEEN 0 AND 5 THEN 0 ELSE 1 END AS fresh FROM cited WINDOW w AS (PARTITION BY query_id ORDER BY citation)),
il AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY citation) AS island FROM fl)"""


@query(_MERGED + " SELECT query_id, CAST(island AS BIGINT) AS island, any_value(path) AS source, count(*) AS span_count, CAST(sum(tokens) AS BIGINT) AS token_count, round(avg(score), 9) AS avg_score, round(max(score), 6) AS max_score, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY citation)) AS text_hash FROM il GROUP BY 1, 2")
def merge_adjacent(t):
    m = adapters.merge_adjacent(cited_of(t))
    return m.select("query_id", "island", "source", "span_count", "token_count", "avg_score", F.round("max_score", 6).alias("max_score"), F.sha2("text", 256).alias("text_hash"))


@query(CITED + " SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, start_line, end_line ORDER BY citation) AS n FROM cited) WHERE n = 1")
def distinct_citations(t):
    return adapters.distinct_citations(cited_of(t)).select("query_id", "id")


@query(CITED + " SELECT query_id, id, CAST(citation AS INT) AS citation FROM cited WHERE citation <= 5")
def similarity_search(t):
    return cited_of(t).filter("citation <= 5").select("query_id", "id", "citation")


@query(_COMPILED.replace(" q.budget, CAST(row_number()", " CAST(10000 AS BIGINT) AS budget, CAST(row_number()") + " SELECT query_id, id, CAST(citation AS INT) AS citation FROM cited WHERE citation <= 5")
def similarity_search_compiled(t):
    return compiler_of(t, enable_mmr=False).similarity_search(requests_of(t), 5).select("query_id", "id", F.col("citation").cast("int").alias("citation"))


_FIRST_CITED = " SELECT query_id, id, CAST(citation AS INT) AS citation FROM cited WHERE citation <= 5"


@query(WITH + _FUSED + _mmr() + _sized("mmr", "10000") + _packed(source="sized") + _cited() + _FIRST_CITED)
def similarity_search_mmr(t):
    return compiler_of(t).similarity_search(requests_of(t), 5).select("query_id", "id", F.col("citation").cast("int").alias("citation"))


@query(WITH + _FUSED + _mmr() + _sized("mmr", "20000") + _packed(source="sized") + _cited() + _FIRST_CITED)
def mmr_search(t):
    return compiler_of(t).mmr_search(requests_of(t), 5).select("query_id", "id", F.col("citation").cast("int").alias("citation"))


_CL = "path || ':' || start_line || '-' || end_line"


@query(CITED + f" SELECT q.query_id, coalesce(string_agg({_CL}, ', ' ORDER BY citation), 'No citations') AS compact, coalesce(string_agg('- `' || {_CL} || '`', chr(10) ORDER BY citation), 'No citations') AS markdown, coalesce(string_agg('  📄 ' || path || ' (lines ' || start_line || '-' || end_line || ')', chr(10) ORDER BY citation), 'No citations') AS verbose FROM req q LEFT JOIN cited c USING (query_id) GROUP BY 1")
def format_citations(t):
    sets = context.working_sets(cited_of(t), requests_of(t))
    return sets.select("query_id", *(adapters.format_citations(F.col("citations"), s).alias(s) for s in ("compact", "markdown", "verbose")))


@query(SETS + """, shown AS (SELECT s.*, CAST(ceil(strlen(text) / 4) AS BIGINT) AS used, coalesce((SELECT string_agg(chr(10) || '  - ' || c.path || ':' || c.start_line || '-' || c.end_line, '' ORDER BY c.citation) FROM cited c WHERE c.query_id = s.query_id AND c.citation <= 10), '') AS lines FROM sets s)
SELECT query_id, 'Query: ' || coalesce(query, '') || chr(10) || 'Spans: ' || n_spans || chr(10) || 'Tokens Used: ' || format('{:,}', used) || chr(10) || 'Deterministic Hash: ' || left(sha256(text), 16) || '...' || chr(10) || chr(10) || 'Citations:' || lines
 || CASE WHEN n_spans > 10 THEN chr(10) || '  ... and ' || (n_spans - 10) || ' more' ELSE '' END || chr(10) || chr(10) || 'Context:' || chr(10) || repeat('─', 60) || chr(10) || left(text, 500) || CASE WHEN length(text) > 500 THEN chr(10) || '...' ELSE '' END AS shown FROM shown""")
def format_working_set(t):
    s = context.working_sets(cited_of(t), requests_of(t))
    return s.select("query_id", adapters.format_working_set(F.col("query"), F.col("citations"), F.col("tokens_used"), F.col("context_hash"), F.col("text")).alias("shown"))


@query(CITED + " SELECT q.query_id, c.id FROM req q LEFT JOIN cited c ON c.query_id = q.query_id AND c.citation = 2")
def citation_at(t):
    sets = context.working_sets(cited_of(t), requests_of(t))
    return sets.select("query_id", adapters.citation_at(F.col("citations"), 2)["id"].alias("id"))


@query(CITED + " SELECT query_id, id FROM cited WHERE score >= 0.014")
def scored_at_least(t):
    return adapters.scored_at_least(cited_of(t), 0.014).select("query_id", "id")


@query(CITED + " SELECT id, count(*) AS times, string_agg(query_id || '#' || citation, ',' ORDER BY query_id, citation) AS citations FROM cited GROUP BY 1")
def citations_of_span(t):
    entry = F.array_sort(F.collect_list(F.struct("query_id", "citation")))
    text = F.array_join(F.transform(entry, lambda c: F.concat(c["query_id"], F.lit("#"), c["citation"].cast("string"))), ",")
    return cited_of(t).groupBy("id").agg(F.count("*").alias("times"), text.alias("citations"))


@query(SETS + ", h AS (SELECT query_id, left(sha256(text), 16) AS h FROM sets) SELECT c.query_id, c.id, h.h AS deterministic_hash, c.path AS source, c.tokens AS token_count FROM cited c JOIN h USING (query_id)")
def span_documents(t):
    cited = cited_of(t)
    hashes = context.working_sets(cited, requests_of(t)).select("query_id", F.left("context_hash", F.lit(16)).alias("deterministic_hash"))
    return cited.join(hashes, "query_id").select("query_id", "id", "deterministic_hash", F.col("path").alias("source"), F.col("tokens").alias("token_count"))


@query("SELECT DISTINCT id, '{\"id\":\"' || id || '\",\"token_budget\":' || token_budget || '}' AS json FROM compile_requests WHERE token_budget IS NOT NULL")
def json_output(t):
    return files.as_json(t("compile_requests").filter("token_budget is not null").select("id", "token_budget").distinct(), "id")


# ---- indexes, embeddings, SQL functions, the session manager --------------------------------------
def _vectors(t) -> tuple[DataFrame, DataFrame]:
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), vectors


def _folder(df: DataFrame, name: str) -> str:
    from uuid import uuid4

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{name}-{uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@query(SQL["cosine_topk_batch"])
def index_exact(t):
    """The exact index, saved, loaded and checked, gives what the search without one gives."""
    asked, vectors = _vectors(t)
    at = index.ExactIndex.load_or_build(vectors.sparkSession, _folder(vectors, "exact"), vectors, 64)
    return at.search(asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def index_overlap(t):
    """Whether the index over cells finds three quarters of the exact result, on average."""
    asked, vectors = _vectors(t)
    cells = index.CellIndex.load_or_build(vectors.sparkSession, _folder(vectors, "cells"), vectors, 64)
    found = index.overlap(cells.search(asked, 10), retrieval.vector_topk(asked, vectors, 10, 64))
    return found.agg(F.count("*").alias("queries"), (F.avg("overlap") >= 0.75).alias("enough"))


@query(f"""{WITH}, h AS (SELECT id, model, text, CASE WHEN {_OK} THEN CAST(embedding AS DOUBLE[]) END AS old, {_HASHED.replace("query", "text")} AS v FROM spv)
SELECT id, CASE WHEN old IS NOT NULL THEN model WHEN text IS NOT NULL THEN 'hash-64' END AS model, round(CASE WHEN old IS NOT NULL THEN old[1] WHEN text IS NOT NULL THEN v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) END, 5) AS first FROM h""")
def attach_embeddings(t):
    out = embedding.attach(spans_of(t, True), embedding.hash_provider(64))
    return out.select("id", "model", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query(f"{WITH} SELECT id, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens, round(CASE WHEN {_OK} AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0 THEN 1 ELSE 0 END, 6) AS self FROM spv WHERE text IS NOT NULL AND len(embedding) = 64 AND {_OK}")
def sql_functions(t):
    spans = spans_of(t, True).filter("text is not null").filter(V.usable(F.col("embedding"), 64))
    sql.register(spans.sparkSession)
    return spans.select("id", F.expr("estimate_tokens(text)").alias("tokens"), F.round(F.expr("cosine_similarity(embedding, embedding)"), 6).alias("self"))


@query(f"{_CHUNKS} SELECT artifact_id, start_line, end_line, sha256(text) AS text_hash, CAST(ceil(strlen(text) / 4) AS BIGINT) AS token_count FROM chunks")
def sql_extract_spans(t):
    rows = artifacts_of(t).filter("content is not null").select(F.col("id").alias("artifact_id"), "content")
    sql.register(rows.sparkSession)
    cut = rows.sparkSession.sql("SELECT artifact_id, s.* FROM {rows}, LATERAL extract_spans(content) s", rows=rows)
    return cut.select("artifact_id", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"), "token_count")


def manager_of(t, first_number: int = 0, **options) -> manager.SessionManager:
    sessions = t("sessions").distinct()
    store = ParquetStore(sessions.sparkSession, _folder(sessions, "sessions"))
    made = manager.SessionManager(store, compiler_of(t, **options), first_number)
    made.create_sessions(sessions)
    return made


def _spoken(first: int) -> str:
    return f"""{WITH}, ok AS (SELECT *, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS late FROM msg WHERE role IN ('user', 'assistant', 'system', 'tool') AND session_id IN (SELECT id FROM ses))
SELECT session_id, id, CAST({first} + row_number() OVER (PARTITION BY session_id ORDER BY late, created_at NULLS LAST, id) - 1 AS INT) AS sequence_number FROM ok"""


def _added(t, first: int) -> DataFrame:
    made, rows = manager_of(t, first), messages_of(t)
    made.add_messages(rows.filter("role = 'user'"))
    made.add_messages(rows.filter("role <> 'user'"))
    return made.messages().select("session_id", "id", "sequence_number")


@query(_spoken(0))
def manager_messages(t):
    """Messages added in two batches: users', then the others, numbered on."""
    return _added(t, 0)


@query(_spoken(1))
def manager_messages_pg(t):
    return _added(t, 1)


_CHAT = "(SELECT min(id) FROM ses WHERE id IS NOT NULL)"


def _chatted(t) -> manager.SessionManager:
    made = manager_of(t, enable_mmr=False)
    session = t("sessions").agg(F.min("id").alias("session_id"))  # one row
    rows = t("compile_requests").distinct().select("id", F.col("query").alias("content"), F.coalesce("token_budget", F.lit(8000)).alias("budget"), "created_at").crossJoin(F.broadcast(session))
    made.add_user_messages(rows)
    return made


@query(_COMPILED + _OUT + f", nm AS (SELECT id, row_number() OVER (ORDER BY created_at NULLS LAST, id) - 1 AS n FROM (SELECT DISTINCT id, created_at FROM compile_requests)) SELECT {_CHAT} AS session_id, s.query_id AS message_id, CAST(n AS INT) AS sequence_number, CAST(ceil(strlen(text) / 4) AS BIGINT) AS tokens_used, sha256(text) AS context_hash FROM sets s JOIN nm ON nm.id = s.query_id")
def manager_user_messages(t):
    """Requests added as user messages of one session: appended, compiled, and stored with their sets."""
    made = _chatted(t)
    numbers = made.messages().select(F.col("id").alias("message_id"), "sequence_number")
    return made.working_sets().join(numbers, "message_id").select("session_id", "message_id", "sequence_number", "tokens_used", "context_hash")


@query(f"SELECT id, CAST(CASE WHEN id = {_CHAT.replace('ses', 'sessions')} THEN (SELECT count(DISTINCT id) FROM compile_requests) ELSE 0 END AS INT) AS messages, CAST(CASE WHEN id = {_CHAT.replace('ses', 'sessions')} THEN (SELECT count(DISTINCT id) FROM compile_requests) ELSE 0 END AS INT) AS working_sets FROM (SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL)")
def manager_full(t):
    full = _chatted(t).full()
    return full.select("id", F.col("n_messages").alias("messages"), F.coalesce(F.size("working_sets"), F.lit(0)).alias("working_sets"))


# ---- settings, projects, counters, other ways in -------------------------------------------------
@query(f"{WITH} SELECT string_split(a.path, '/')[1] AS project, count(*) AS artifacts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS spans, CAST(sum(coalesce(k, 0)) AS BIGINT) AS tokens FROM art a LEFT JOIN (SELECT artifact_id, count(*) AS n, sum(greatest(coalesce(token_count, 0), 0)) AS k FROM sp GROUP BY 1) s ON s.artifact_id = a.id GROUP BY 1")
def project_catalog(t):
    return service.project_catalog(artifacts_of(t), spans_of(t))


@query("SELECT event_type, count(value) AS count, CAST(coalesce(sum(floor(abs(value))), 0) AS BIGINT) AS total_ms, CASE WHEN count(value) > 0 THEN CAST(floor(coalesce(sum(floor(abs(value))), 0) / count(value)) AS BIGINT) ELSE 0 END AS avg_ms FROM events GROUP BY 1")
def compile_counters(t):
    return service.counters(t("events").withColumn("value", F.abs("value")), "event_type", "value")


@query(SETS + " SELECT query_id, sha256(text) AS answer FROM sets")
def ask_without_model(t):
    return service.ask(context.working_sets(cited_of(t), requests_of(t))).select("query_id", F.sha2("answer", 256).alias("answer"))


@query("SELECT DISTINCT id, CASE WHEN backend LIKE 'postgres://%' OR backend LIKE 'postgresql://%' THEN 'postgres' ELSE 'sqlite' END AS kind, CASE WHEN backend LIKE 'postgres://%' OR backend LIKE 'postgresql://%' THEN backend WHEN backend LIKE 'sqlite:%' THEN substr(backend, 8) ELSE 'local.db' END AS place FROM (SELECT id, coalesce(backend, '') || CASE WHEN id < '8' THEN '://host/db' ELSE ':/x.db' END AS backend FROM compile_requests)")
def storage_settings(t):
    named = F.concat(F.coalesce("backend", F.lit("")), F.when(F.col("id") < "8", "://host/db").otherwise(":/x.db"))
    return t("compile_requests").select("id", service.storage_kind(named, "local.db").alias("s")).distinct().select("id", "s.*")


@query("SELECT DISTINCT id, coalesce(token_budget, 8000) AS token_budget, true AS enable_mmr, 0.5::DOUBLE AS mmr_lambda, CAST(50 AS INT) AS candidate_limit FROM compile_requests")
def pg_settings(t):
    given = F.to_json(F.struct("token_budget", F.lit("x").alias("other")))
    return t("compile_requests").select("id", service.pg_config(given).alias("c")).distinct().select("id", "c.*")


@query(WITH + _SEM + " SELECT m.query_id, m.rank, m.id AS span_id, a.path AS artifact_path, round(m.score, 6) AS score FROM sem m JOIN sp s ON s.id = m.id LEFT JOIN art a ON a.id = s.artifact_id WHERE m.rank <= 10")
def search_spans_pg(t):
    asked = requests_of(t).select("query_id", V.hash_embedding(F.coalesce("query", F.lit("")), 64).alias("embedding"))
    found = service.search_spans(asked, spans_of(t, True), artifacts_of(t))
    of = lambda k: F.get_json_object("result", f"$.{k}")
    return found.select("query_id", "rank", of("span_id").alias("span_id"), of("artifact_path").alias("artifact_path"), F.round(of("score").cast("double"), 6).alias("score"))


@query(f"{WITH}, d AS ({_DOOMED}) SELECT (SELECT count(*) FROM art) AS artifacts, count(*) AS spans FROM sp WHERE artifact_id IS NULL OR artifact_id NOT IN (SELECT id FROM d)")
def delete_spans_pg(t):
    left = service.delete_spans(spans_of(t), _doomed(t)).agg(F.count("*").alias("spans"))
    return artifacts_of(t).agg(F.count("*").alias("artifacts")).crossJoin(left)  # one row each


# ---- events and general checks --------------------------------------------------------------------
@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(t):
    out = streaming.windowed_counts(t("events"))
    return out.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, s""")
def event_sessions(t):
    out = streaming.sessionized(t("events"))
    return out.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("session_start"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_paths(t):
    return t("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["compile_context_mmr"](spark, d)
