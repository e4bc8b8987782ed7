"""Queries pN_ of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window

from weft.runtime import table, tune


def _p1(spark: SparkSession, d: str):
    from weft.llm.near_duplicates import NearDuplicates, span_and_artifact_records

    tune(spark)
    return NearDuplicates(span_and_artifact_records(table(spark, d, "spans"), table(spark, d, "artifacts")), width=3, threshold=0.7)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).pairs()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).groups()


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of classes each step of the search leaves."""
    return _p1(spark, d).steps()


def _similar(spans: DataFrame, **options) -> DataFrame:
    from pyspark.sql import functions as F

    from weft.llm.vectors import similar_vectors

    return similar_vectors(spans.select("id", F.col("model").alias("grp"), "embedding"), **options)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.vectors import mutual_pairs

    tune(spark)
    ranked = _similar(table(spark, d, "spans"), k=5, least=0.9, tables=8, probes=4, growth=1 / 3)
    return mutual_pairs(ranked).toDF("span_a", "span_b")


def _asked():
    """Whether the id is divisible by 20: its last eight digits, read as a hexadecimal number."""
    from pyspark.sql import functions as F

    return F.coalesce(F.expr("try_to_number(conv(right(id, 8), 16, 10), '9999999999') % 20 = 0"), F.lit(False))


def p2_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar spans of each span whose id is divisible by 20, among all spans of its model."""
    from pyspark.sql import functions as F

    ranked = _similar(table(tune(spark), d, "spans"), k=10, asks=_asked())
    return ranked.select(F.col("a").alias("span_id"), F.col("b").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "rank")


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """(model, queries, recall): the share of the 10 most similar spans that p2_topk finds, by the exact
    search of the same queries over all rows, in blocks of queries."""
    from functools import reduce

    from pyspark.sql import functions as F

    from weft.llm.vectors import recall, usable
    from weft.operators.retrieval import vector_topk

    spans = table(tune(spark), d, "spans").select("id", F.col("model").alias("grp"), "embedding")
    rows = usable(spans, 64).groupBy("id", "grp").agg(F.min("embedding").alias("embedding"))
    exact = []
    for (grp,) in spans.select("grp").filter("grp is not null").distinct().toLocalIterator():  # a few models
        own = rows.filter(F.col("grp") == grp)
        found = vector_topk(own.filter(_asked()).select(F.col("id").alias("query_id"), "embedding"), own.select("id", "embedding"), 11, 64)
        found = found.filter("query_id <> id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        exact.append(found.filter("place <= 10").select(F.lit(grp).alias("grp"), F.col("query_id").alias("a"), F.col("id").alias("b")))
    if not exact:
        return spark.createDataFrame([], "model string, queries long, recall double")
    found = recall(p2_topk(spark, d).select(F.col("span_id").alias("a"), F.col("neighbour_id").alias("b")), reduce(DataFrame.unionByName, exact))
    return found.select(F.col("grp").alias("model"), "queries", F.round("recall", 4).alias("recall"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.conversations import sound_turns

    return sound_turns(*(table(tune(spark), d, t) for t in ("messages", "sessions", "role_aliases")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation, threads without a session id included, and what is wrong with it."""
    from weft.llm.conversations import reports

    return reports(*(table(tune(spark), d, t) for t in ("messages", "role_aliases")))


def p3_threads(spark: SparkSession, d: str) -> DataFrame:
    """The conversations put together from messages without a session id, sound or not."""
    from weft.llm.conversations import threads

    return threads(*(table(tune(spark), d, t) for t in ("messages", "role_aliases")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).select("kind", "item_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.splitting import split_corpus

    return split_corpus(*(table(tune(spark), d, t) for t in ("spans", "artifacts")))


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized item is covered to its end by pieces within the limits that overlap."""
    from weft.llm.splitting import faults

    return faults(p4_pieces(spark, d))


def p5_bins(spark: SparkSession, d: str) -> DataFrame:
    """The container of every candidate span of every request; split spans have several rows."""
    from weft.llm.packing import pack_items, request_items

    return pack_items(request_items(*(table(tune(spark), d, t) for t in ("compile_requests", "request_spans", "spans"))))


def p5_apart(spark: SparkSession, d: str) -> DataFrame:
    """The same with a conflict between spans of one artifact too: no container holds two of them."""
    from weft.llm.packing import pack_items, request_items

    return pack_items(request_items(*(table(tune(spark), d, t) for t in ("compile_requests", "request_spans", "spans"))), forbid=(True, True))


def _p5_faults(spark: SparkSession, d: str, packed: DataFrame, forbid: tuple[bool, bool]) -> DataFrame:
    from weft.llm.packing import faults, request_items

    return faults(packed, request_items(*(table(spark, d, t) for t in ("compile_requests", "request_spans", "spans"))), forbid).withColumnRenamed("group_id", "request_id")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Every item of a request is packed whole, no container is too full or holds a conflict."""
    return _p5_faults(spark, d, p5_bins(spark, d), (False, True))


def p5_apart_check(spark: SparkSession, d: str) -> DataFrame:
    return _p5_faults(spark, d, p5_apart(spark, d), (True, True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_bins(spark, d).filter("parts > 1").selectExpr("group_id as request_id", "item_id as span_id").distinct()


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.packing import summary

    return summary(p5_bins(spark, d)).withColumnRenamed("group_id", "request_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_screened(spark, d).filter("is_case").select("item_id").distinct()


def p6_screened(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the verdict: those that are no case bring something new."""
    from weft.llm.history import screen_items

    return screen_items(*(table(tune(spark), d, t) for t in ("artifacts", "ingest_items")))


def p6_increment(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts on the last batch, against an index to which the others have been appended before."""
    from weft.llm.history import screen_increment

    return screen_increment(*(table(tune(spark), d, t) for t in ("artifacts", "ingest_items")))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.encoding import encode

    return encode(table(tune(spark), d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.mixing import mix

    return mix(*(table(tune(spark), d, t) for t in ("documents", "mix_targets")))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.mixing import report

    return report(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """(source, within_share, within_repeats) of the sources that have documents: whether the actual share
    is within 1 % of the target among them, and no document is taken too often."""
    from pyspark.sql import functions as F

    has = p8_report(spark, d).filter("tokens > 0").withColumn("all_targets", F.sum("target_share").over(Window.partitionBy()))  # one row a source
    share = F.abs(F.col("actual_share") / (F.col("target_share") / F.col("all_targets")) - 1) <= 0.01
    return has.select("source", share.alias("within_share"), (F.col("most_copies") <= F.col("allowed")).alias("within_repeats"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from weft.llm.sentences import find_sentences

    return find_sentences(table(tune(spark), d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_BLANK = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
_MARK = "CASE WHEN speaker IN ('user', 'assistant') THEN speaker END"
_PAST = "OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

_P5 = """SELECT request_id, count(*) AS items, CAST(sum(n) AS BIGINT) AS size, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS clashes, CAST(0 AS BIGINT) AS cut FROM (SELECT r.request_id, r.span_id, max(s.token_count) AS n
FROM request_spans r JOIN compile_requests q ON q.id = r.request_id JOIN spans s ON s.id = r.span_id WHERE s.token_count > 0 AND coalesce(q.token_budget, 8000) >= 1 GROUP BY 1, 2) GROUP BY 1"""

SQL = {
    "p1_found": """WITH rec AS (SELECT DISTINCT 'span' AS kind, id, text FROM spans WHERE text IS NOT NULL UNION SELECT DISTINCT 'artifact', id, content FROM artifacts WHERE content IS NOT NULL),
w AS (SELECT kind, id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM rec),
s AS (SELECT kind, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
t AS (SELECT kind, id, len(s) AS n, unnest(s) AS t FROM s)
SELECT kind, id_a, id_b FROM (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n + b.n) AS n FROM t a JOIN t b ON a.kind = b.kind AND a.t = b.t AND a.id < b.id GROUP BY ALL) WHERE 10 * c >= 7 * (n - c)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
    "p2_found": """WITH v AS (SELECT DISTINCT id, model, CAST(embedding AS DOUBLE[]) AS v FROM spans WHERE model IS NOT NULL AND len(embedding) = 64 AND NOT coalesce(list_contains(list_transform(embedding, lambda x: isfinite(x)), false), false) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.model = b.model AND a.id <> b.id),
r AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM c WHERE s >= 0.9) WHERE k <= 5)
SELECT x.a AS span_a, x.b AS span_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p3_found": rf"""WITH m AS (SELECT DISTINCT * FROM messages WHERE id IS NOT NULL AND session_id IN (SELECT id FROM sessions)),
r AS (SELECT m.*, a.role AS speaker FROM m LEFT JOIN role_aliases a ON a.alias = lower(regexp_replace(m.role, '^{_BLANK}+|{_BLANK}+$', '', 'g'))),
d AS (SELECT *, CASE WHEN sequence_number IS NOT NULL AND content IS NOT NULL AND role IS NOT NULL THEN row_number() OVER (PARTITION BY session_id, sequence_number, coalesce(speaker, '?' || role), content ORDER BY created_at NULLS LAST, id) ELSE 1 END AS copy FROM r),
k AS (SELECT *, bool_or(sequence_number IS NULL) OVER (PARTITION BY session_id) AS unnumbered FROM d WHERE copy = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN NOT unnumbered THEN sequence_number END NULLS LAST, CASE WHEN unnumbered THEN created_at END NULLS LAST, id) - 1 AS turn_no FROM k),
x AS (SELECT *, last_value({_MARK} IGNORE NULLS) {_PAST} AS before, max(CASE WHEN speaker <> 'system' THEN 1 END) {_PAST} AS spoken FROM o),
bad AS (SELECT session_id FROM x GROUP BY 1 HAVING bool_or(speaker IS NULL) OR bool_or(content IS NULL OR regexp_matches(content, '^{_BLANK}*$'))
 OR (NOT bool_or(unnumbered) AND (count(DISTINCT sequence_number) < count(*) OR max(sequence_number) - min(sequence_number) + 1 > count(*) OR min(sequence_number) NOT IN (0, 1)))
 OR NOT coalesce(bool_or(speaker <> 'system'), false) OR bool_or(speaker <> 'system' AND spoken IS NULL AND speaker <> 'user') OR bool_or(speaker = 'user' AND coalesce(before, '') = 'user')
 OR coalesce(max_by(speaker, turn_no) FILTER (speaker IN ('user', 'assistant')) <> 'assistant', true))
SELECT session_id, turn_no, id AS message_id FROM x WHERE session_id NOT IN (SELECT session_id FROM bad)""",
    "p3_threads": rf"""WITH RECURSIVE m AS (SELECT DISTINCT * FROM messages WHERE id IS NOT NULL AND session_id IS NULL),
l AS (SELECT id AS u, unnest([json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.reply_to'), json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.quotes')]) AS v FROM m),
e AS (SELECT u, v FROM l WHERE v IN (SELECT id FROM m) UNION SELECT v, u FROM l WHERE v IN (SELECT id FROM m)),
w AS (SELECT id AS node, id AS other FROM m UNION SELECT w.node, e.v FROM w JOIN e ON e.u = w.other),
c AS (SELECT node, min(other) AS component FROM w GROUP BY 1),
r AS (SELECT m.*, 'thread:' || c.component AS session, a.role AS speaker FROM m JOIN c ON c.node = m.id LEFT JOIN role_aliases a ON a.alias = lower(regexp_replace(m.role, '^{_BLANK}+|{_BLANK}+$', '', 'g'))),
d AS (SELECT *, CASE WHEN sequence_number IS NOT NULL AND content IS NOT NULL AND role IS NOT NULL THEN row_number() OVER (PARTITION BY session, sequence_number, coalesce(speaker, '?' || role), content ORDER BY created_at NULLS LAST, id) ELSE 1 END AS copy FROM r),
k AS (SELECT *, bool_or(sequence_number IS NULL) OVER (PARTITION BY session) AS unnumbered FROM d WHERE copy = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN NOT unnumbered THEN sequence_number END NULLS LAST, CASE WHEN unnumbered THEN created_at END NULLS LAST, id) - 1 AS turn_no FROM k),
x AS (SELECT *, last_value({_MARK} IGNORE NULLS) {_PAST.replace("session_id", "session")} AS before, max(CASE WHEN speaker <> 'system' THEN 1 END) {_PAST.replace("session_id", "session")} AS spoken FROM o),
f AS (SELECT session, CASE WHEN bool_or(speaker IS NULL) THEN 'unknown role' WHEN bool_or(content IS NULL OR regexp_matches(content, '^{_BLANK}*$')) THEN 'empty message'
 WHEN NOT bool_or(unnumbered) AND (count(DISTINCT sequence_number) < count(*) OR max(sequence_number) - min(sequence_number) + 1 > count(*) OR min(sequence_number) NOT IN (0, 1)) THEN 'gap or collision'
 WHEN NOT coalesce(bool_or(speaker <> 'system'), false) THEN 'nobody speaks' WHEN bool_or(speaker <> 'system' AND spoken IS NULL AND speaker <> 'user') THEN 'does not open with the user'
 WHEN bool_or(speaker = 'user' AND coalesce(before, '') = 'user') OR coalesce(max_by(speaker, turn_no) FILTER (speaker IN ('user', 'assistant')) <> 'assistant', true) THEN 'missing reply' END AS fault FROM x GROUP BY 1)
SELECT session AS conversation_id, turn_no, id AS message_id, fault FROM x JOIN f USING (session)""",
    "p4_found": """SELECT DISTINCT 'artifact' AS kind, id AS item_id FROM artifacts WHERE length(content) > 12000 UNION ALL
SELECT DISTINCT 'span', id FROM spans WHERE length(text) > 2000 OR length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END > 40""",
    "p4_check": """SELECT kind, item_id, CAST(length(text) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS overlong, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS apart FROM (SELECT DISTINCT 'artifact' AS kind, id AS item_id, content AS text FROM artifacts WHERE length(content) > 12000 UNION ALL
SELECT DISTINCT 'span', id, text FROM spans WHERE length(text) > 2000 OR length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END > 40)""",
    "p5_found": """SELECT DISTINCT r.request_id, r.span_id FROM request_spans r JOIN compile_requests q ON q.id = r.request_id JOIN spans s ON s.id = r.span_id WHERE s.token_count > coalesce(q.token_budget, 8000) AND s.token_count > 0""",
    "p5_check": _P5,
    "p5_apart_check": _P5,
    "p8_check": r"""SELECT lower(trim(t.source)) AS source, true AS within_share, true AS within_repeats FROM mix_targets t
WHERE t.target_share > 0 AND t.max_repeats >= 1 AND lower(trim(t.source)) IN (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) FROM documents WHERE length(text) > 0)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
