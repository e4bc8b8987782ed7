"""Sessions and messages: numbering, history, replay and analytics.

The order of a session's messages is by sequence number (null last), time (null last) and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from weft.functions import text as T


def message_order() -> list[Column]:
    return [F.col("sequence_number").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id")]


def numbered(messages: DataFrame) -> DataFrame:
    """messages with position, from 0, in their session; messages without a session are left out."""
    w = W.partitionBy("session_id").orderBy(*message_order())
    return messages.filter("session_id is not null").withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def appended_numbers(existing: DataFrame, added: DataFrame) -> DataFrame:
    """added (session_id, id, created_at, ...) with the sequence numbers that follow those in use."""
    top = existing.groupBy("session_id").agg(F.max("sequence_number").alias("top"))
    w = W.partitionBy("session_id").orderBy(F.col("created_at").asc_nulls_last(), "id")
    return added.join(top, "session_id", "left").withColumn("sequence_number", (F.coalesce("top", F.lit(-1)) + F.row_number().over(w)).cast("int")).drop("top")


def oldest_messages(messages: DataFrame, n: int) -> DataFrame:
    return numbered(messages).filter(F.col("position") < n)


def recent_sessions(sessions: DataFrame, n: int, per_user: bool = False) -> DataFrame:
    """The n sessions updated last, of all or of each user."""
    order = [F.col("updated_at").desc_nulls_last(), F.col("id")]
    if not per_user:
        return sessions.orderBy(*order).limit(n)
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(*order))
    return sessions.filter("user_id is not null").withColumn("rank", rank).filter(F.col("rank") <= n)


def history_window(messages: DataFrame, most: int) -> DataFrame:
    """The newest messages whose estimated tokens sum to at most ``most``; the first that would exceed
    it ends the window. Null contents count 0 tokens."""
    tokens = F.coalesce(T.estimate_tokens(F.col("content")), F.lit(0))
    back = W.partitionBy("session_id").orderBy(F.col("position").desc()).rowsBetween(W.unboundedPreceding, 0)
    return numbered(messages).withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(back)).filter(F.col("running") <= most)


def _joined(rows: DataFrame, line: Column, name: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias(name))


def conversation_history(messages: DataFrame, most: int | None = None, upper: bool = False) -> DataFrame:
    """(session_id, history): role and content of each message, blank lines between; with ``upper`` the
    role in capitals and the line trimmed. A limit in tokens keeps the newest messages."""
    rows = numbered(messages) if most is None else history_window(messages, most)
    role = F.coalesce(F.trim(F.lower("role")), F.lit("unknown"))
    name = F.upper(role) if upper else F.concat(F.upper(F.left(role, F.lit(1))), F.substr(role, F.lit(2)))
    line = F.concat(name, F.lit(": "), F.coalesce("content", F.lit("")))
    return _joined(rows, F.trim(line) if upper else line, "history")


def replay(messages: DataFrame, working_sets: DataFrame | None = None) -> DataFrame:
    """(session_id, turn, user_message_id, query, assistant_message_id, answer[, working_set_id]): each
    user message, with the assistant's if that comes next, and the newest working set of the message.

    ``working_sets`` has id, message_id and created_at.
    """
    w = W.partitionBy("session_id").orderBy("position")
    role = F.trim(F.lower("role"))
    rows = numbered(messages).withColumn("role", role)
    after = lambda c: F.lead(c).over(w)
    answered = F.col("next_role") == "assistant"
    rows = rows.withColumns({"next_role": after("role"), "next_id": after("id"), "next_content": after("content")}).filter("role = 'user'")
    turns = rows.select(
        "session_id", (F.row_number().over(w) - 1).cast("long").alias("turn"), F.col("id").alias("user_message_id"), F.col("content").alias("query"),
        F.when(answered, F.col("next_id")).alias("assistant_message_id"), F.when(answered, F.col("next_content")).alias("answer"),
    )
    if working_sets is None:
        return turns
    newest = working_sets.filter("message_id is not null").groupBy(F.col("message_id").alias("user_message_id")).agg(F.max_by("id", F.struct("created_at", "id")).alias("working_set_id"))
    return turns.join(newest, "user_message_id", "left")


def session_analytics(messages: DataFrame) -> DataFrame:
    """(session_id, turns, total_tokens, avg_tokens): the tokens are those of the answers."""
    turns = replay(messages)
    tokens = F.coalesce(T.estimate_tokens(F.col("answer")), F.lit(0))
    out = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(tokens).alias("total_tokens"))
    return out.withColumn("avg_tokens", F.round(F.col("total_tokens") / F.col("turns"), 6))


def user_report(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(user_id, sessions, turns, tokens, avg_turns, avg_tokens, recent) with each user's last 5 queries."""
    owned = sessions.filter("user_id is not null").select(F.col("id").alias("session_id"), "user_id", F.col("created_at").alias("began")).dropDuplicates(["session_id"])
    stats = owned.join(session_analytics(messages), "session_id", "left").groupBy("user_id").agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")
    )
    asked = owned.join(replay(messages).select("session_id", "turn", "query"), "session_id")
    late = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("began").desc_nulls_last(), F.col("session_id").desc(), F.col("turn").desc()))
    last = asked.withColumn("late", late).filter("late <= 5")
    text = F.coalesce(F.substring("query", 1, 60), F.lit(""))
    recent = last.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("late")).alias("o"), text.alias("q")))), lambda x: x["q"]), " | ").alias("recent"))
    out = stats.join(recent, "user_id", "left")
    return out.select(
        "user_id", "sessions", "turns", "tokens", F.round(F.col("turns") / F.col("sessions"), 6).alias("avg_turns"),
        F.when(F.col("turns") > 0, F.round(F.col("tokens") / F.col("turns"), 6)).otherwise(F.lit(0.0)).alias("avg_tokens"), F.coalesce("recent", F.lit("")).alias("recent"),
    )


def empty_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions without a user message."""
    asked = messages.filter(F.trim(F.lower("role")) == "user").select(F.col("session_id").alias("id"))
    return sessions.join(asked, "id", "left_anti")


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions with last_message_at taken from their messages."""
    last = messages.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("last_message_at"), F.count("*").alias("n_messages"))
    return sessions.drop("last_message_at").join(last, "id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))


def update_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """sessions (id, title, metadata) after changes (id, title, metadata); nulls keep what is there."""
    new = changes.select("id", F.col("title").alias("new_title"), F.col("metadata").alias("new_metadata"))
    return sessions.join(new, "id", "left").withColumns({"title": F.coalesce("new_title", "title"), "metadata": F.coalesce("new_metadata", "metadata")}).drop("new_title", "new_metadata")


def delete_sessions(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """All tables without the sessions of ``doomed`` (id) and what belongs to them."""
    gone = doomed.select(F.col("id").alias("session_id")).distinct()
    out = {}
    for name, df in tables.items():
        own = gone.withColumnRenamed("session_id", "id") if name == "sessions" else gone
        out[name] = df.join(own, own.columns[0], "left_anti")
    return out


def session_full(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, title, n_messages, messages): each session with its ordered messages as an array."""
    entry = F.struct("position", F.col("id").alias("message_id"), "role", "content")
    own = numbered(messages).groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("messages"))
    out = sessions.select("id", "title").join(own, "id", "left")
    return out.withColumn("n_messages", F.coalesce(F.size("messages"), F.lit(0)))
