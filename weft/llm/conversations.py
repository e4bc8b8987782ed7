"""Rebuilding ordered conversations from message rows.

A message belongs to the conversation of its session id. Messages without one are put together by
their reply and quote links: the links (metadata keys ``reply_to`` and ``quotes``, naming message ids)
among such messages form a graph, and each connected component is a conversation of its own. Then every
conversation is ordered, numbered and checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from weft.llm.components import connected_components

LINKS = ("reply_to", "quotes")
#: White space by Unicode, as a class for Java patterns.
BLANK = r"(?U)^\s*$"
_OUTER = r"(?U)^\s+|\s+$"


def thread_links(messages: DataFrame) -> DataFrame:
    """(u, v): links among messages that have no session id."""
    loose = messages.filter("session_id is null and id is not null")
    targets = [F.get_json_object("metadata", f"$.{key}") for key in LINKS]
    ends = loose.select(F.col("id").alias("u"), F.explode(F.array(*targets)).alias("v")).filter("v is not null")
    return ends.join(loose.select(F.col("id").alias("v")).distinct(), "v", "left_semi").select("u", "v")


def conversation_keys(messages: DataFrame) -> DataFrame:
    """messages with conversation_id: the session id or, without one, ``thread:`` and the least
    message id of the component over reply and quote links."""
    found = connected_components(thread_links(messages))
    loose = messages.filter("session_id is null").join(found.withColumnRenamed("node", "id"), "id", "left")
    own = F.concat(F.lit("thread:"), F.coalesce("component", "id"))
    return messages.filter("session_id is not null").withColumn("conversation_id", F.col("session_id")).unionByName(
        loose.withColumn("conversation_id", own).drop("component")
    )


def _roles(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """The known role of each message as ``speaker``; null if unknown. The alias table is a short list
    of names, but it is not hinted: the optimizer broadcasts it by its size."""
    alias = aliases.select(F.lower(F.regexp_replace("alias", _OUTER, "")).alias("alias"), F.col("role").alias("speaker")).filter("alias is not null")
    named = messages.withColumn("alias", F.lower(F.regexp_replace("role", _OUTER, "")))
    return named.join(alias.dropDuplicates(["alias"]), "alias", "left").drop("alias")


def turns(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(conversation_id, session_id, turn_no, message_id, speaker, content, fault) for every message of
    every conversation, in order; ``fault`` says why the conversation is not sound, null if it is.

    Repeated rows count once, and of messages with equal non-null sequence number, role and content
    the earliest stands (by time, null times last, then id). The order is by sequence number or, if
    any is null in the conversation, by time (null times last), then id.

    The rows are shuffled once, by conversation: copies, order and all checks are windows over that
    partitioning, whose buffers spill, so memory does not grow with the length of a conversation.
    """
    columns = ["id", "session_id", "role", "content", "metadata", "sequence_number", "created_at"]
    messages = messages.select(*columns).filter("id is not null")
    rows = _roles(conversation_keys(messages), aliases).repartition("conversation_id")
    rows = rows.dropDuplicates(["conversation_id", *columns])
    earliest = W.partitionBy("conversation_id", "sequence_number", F.coalesce("speaker", F.concat(F.lit("?"), "role")), "content").orderBy(F.col("created_at").asc_nulls_last(), "id")
    whole = F.col("sequence_number").isNotNull() & F.col("content").isNotNull() & F.col("role").isNotNull()
    rows = rows.withColumn("copy", F.when(whole, F.row_number().over(earliest)).otherwise(1)).filter("copy = 1")
    return _checked(rows)


def _checked(rows: DataFrame) -> DataFrame:
    talk = W.partitionBy("conversation_id")
    rows = rows.withColumns(
        {
            "unnumbered": F.max(F.col("sequence_number").isNull()).over(talk),
            "lowest": F.min("sequence_number").over(talk),
            "highest": F.max("sequence_number").over(talk),
            "size": F.count(F.lit(1)).over(talk),
            "stranger": F.max(F.col("speaker").isNull()).over(talk),
            "hollow": F.max(F.col("content").isNull() | F.col("content").rlike(BLANK)).over(talk),
        }
    )
    by_time = F.when(F.col("unnumbered"), F.col("created_at"))
    ordered = talk.orderBy(F.when(~F.col("unnumbered"), F.col("sequence_number")).asc_nulls_last(), by_time.asc_nulls_last(), F.col("id"))
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    spoken = F.col("speaker") != "system"
    # The speaker that matters next: after a user, an assistant must come before the next user.
    marks = F.when(F.col("speaker").isin("user", "assistant"), F.col("speaker"))
    rows = rows.withColumns(
        {
            "turn_no": (F.row_number().over(ordered) - 1).cast("long"),
            "before": F.last(marks, True).over(earlier),
            "spoken_before": F.max(F.when(spoken, 1)).over(earlier),
            "number_before": F.lag("sequence_number").over(ordered),
            "closing": F.last(marks, True).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        }
    )
    ever = lambda c: F.max(F.coalesce(c, F.lit(False))).over(talk)
    rows = rows.withColumns(
        {
            "collision": ever(F.col("sequence_number") == F.col("number_before")),
            "any_spoken": ever(spoken),
            "no_opening": ever(spoken & F.col("spoken_before").isNull() & (F.col("speaker") != "user")),
            "unanswered": ever((F.col("speaker") == "user") & (F.col("before") == "user")),
        }
    )
    gap = ~F.col("unnumbered") & (F.col("collision") | (F.col("highest") - F.col("lowest") + 1 != F.col("size")) | ~F.col("lowest").isin(0, 1))
    fault = (
        F.when(F.col("stranger"), "unknown role")
        .when(F.col("hollow"), "empty message")
        .when(gap, "gap or collision")
        .when(~F.col("any_spoken"), "nobody speaks")
        .when(F.col("no_opening"), "does not open with the user")
        .when(F.col("unanswered") | ~F.coalesce(F.col("closing") == "assistant", F.lit(False)), "missing reply")
    )
    return rows.select("conversation_id", "session_id", "turn_no", F.col("id").alias("message_id"), "speaker", "content", fault.alias("fault"))


def sound_turns(messages: DataFrame, sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(session_id, turn_no, message_id) of the sound conversations of known sessions.

    Null, empty and unknown session ids give nothing. Messages without a session id come out of
    ``turns`` under the id of their thread.
    """
    known = sessions.select(F.col("id").alias("session_id")).filter("session_id is not null").distinct()
    return turns(messages, aliases).filter("fault is null").join(known, "session_id", "left_semi").select("session_id", "turn_no", "message_id")


def reports(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a conversation: conversation_id, n_messages, fault (``sound`` if there is none)."""
    return turns(messages, aliases).groupBy("conversation_id").agg(
        F.count("*").alias("n_messages"), F.coalesce(F.first("fault"), F.lit("sound")).alias("fault")
    )


def threads(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(conversation_id, turn_no, message_id, fault) of the conversations that have no session id: the
    components over reply and quote links, each under its least message id. Sound ones have a null fault."""
    return turns(messages.filter("session_id is null"), aliases).select("conversation_id", "turn_no", "message_id", "fault")
