"""Agents and the relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from weft.operators.sessions import numbered


def agent_id(metadata: Column) -> Column:
    """The agent named by a message's metadata; null for broken JSON."""
    return F.get_json_object(metadata, "$.agent_id")


def upsert_agents(agents: DataFrame, changes: DataFrame) -> DataFrame:
    """agents with the rows of ``changes`` in place of those of the same id."""
    return agents.join(changes.select("id"), "id", "left_anti").select(*agents.columns).unionByName(changes.select(*agents.columns))


def relations(messages: DataFrame, stance: Column) -> DataFrame:
    """(id, session_id, message_id, from_agent_id, to_agent_id, stance, target_message_id, created_at):
    each message of an agent answers the message before it in the session; ``stance`` is an expression
    on position. A target without an agent is ``unknown``."""
    w = W.partitionBy("session_id").orderBy("position")
    rows = numbered(messages).withColumn("agent", agent_id(F.col("metadata")))
    rows = rows.withColumns({"target": F.lag("id").over(w), "to_agent": F.lag("agent").over(w)})
    return rows.filter("agent is not null and target is not null").select(
        F.sha2(F.concat_ws("|", "id", "target"), 256).alias("id"), "session_id", F.col("id").alias("message_id"), F.col("agent").alias("from_agent_id"),
        F.coalesce("to_agent", F.lit("unknown")).alias("to_agent_id"), stance.alias("stance"), F.col("target").alias("target_message_id"), "created_at",
    )


def named_relations(relations: DataFrame, agents: DataFrame) -> DataFrame:
    """relations with the names and models of both agents (``unknown`` and ``?`` where missing)."""
    for end in ("from", "to"):
        side = agents.select(F.col("id").alias(f"{end}_agent_id"), F.col("name").alias(f"{end}_name"), F.col("model").alias(f"{end}_model")).dropDuplicates([f"{end}_agent_id"])
        relations = relations.join(side, f"{end}_agent_id", "left")
        relations = relations.withColumns({f"{end}_name": F.coalesce(f"{end}_name", F.lit("unknown")), f"{end}_model": F.coalesce(f"{end}_model", F.lit("?"))})
    return relations


def summary(relations: DataFrame, agents: DataFrame, neutrals: bool = False) -> DataFrame:
    """(session_id, agreements, disagreements, questions[, neutrals]) as texts ``from>to``, by time."""
    named = named_relations(relations, agents)
    text = F.concat(F.col("from_name"), F.lit("("), F.col("from_model"), F.lit(")>"), F.col("to_name"))

    def listed(stance: str) -> Column:
        entry = F.when(F.lower("stance") == stance, F.struct("created_at", "message_id", text.alias("t")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ";")

    kinds = {"agreements": "agree", "disagreements": "disagree", "questions": "question"} | ({"neutrals": "neutral"} if neutrals else {})
    return named.groupBy("session_id").agg(*(listed(s).alias(n) for n, s in kinds.items()))


def session_agents(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """(session_id, agent_id, name): the agents that wrote in each session."""
    wrote = messages.filter("session_id is not null").select("session_id", agent_id(F.col("metadata")).alias("id")).filter("id is not null").distinct()
    return wrote.join(agents.select("id", "name"), "id").select("session_id", F.col("id").alias("agent_id"), "name").distinct()
