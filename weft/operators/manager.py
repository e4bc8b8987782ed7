"""Sessions as one interface over a store: conversations, messages and the working sets made for them.

All operations take and return batches. ``first_number`` is 0, or 1 in the other profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.functions.labels import valid_role
from weft.operators import sessions as S
from weft.plans.compile import Compiler
from weft.runtime import stage
from weft.sources.store import Store

SESSIONS = "id string, user_id string, title string, metadata string, created_at timestamp, updated_at timestamp, last_message_at timestamp"
MESSAGES = "id string, session_id string, role string, content string, metadata string, sequence_number int, created_at timestamp"
WORKING_SETS = "id string, session_id string, message_id string, query string, text string, citations string, tokens_used long, context_hash string, created_at timestamp"


def _shaped(rows: DataFrame, schema: str, **given: Column) -> DataFrame:
    """The columns of a schema, null where the rows have none."""
    fields = [f.split() for f in schema.split(", ")]
    return rows.select(*((given[n] if n in given else F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


class SessionManager:
    def __init__(self, store: Store, compiler: Compiler | None = None, first_number: int = 0) -> None:
        self.store, self.compiler, self.first_number = store, compiler, first_number

    # ---- sessions
    def sessions(self) -> DataFrame:
        return self.store.read("sessions", SESSIONS)

    def create_sessions(self, rows: DataFrame) -> None:
        """Add sessions (id, user_id, title, ...); ids that are there, and null ones, are left out."""
        new = rows.filter("id is not null").join(self.sessions().select("id"), "id", "left_anti").dropDuplicates(["id"])
        now = F.coalesce(F.col("created_at"), F.current_timestamp()) if "created_at" in rows.columns else F.current_timestamp()
        self.store.append("sessions", _shaped(new, SESSIONS, created_at=now, updated_at=now))

    def update_sessions(self, changes: DataFrame) -> None:
        """New titles and metadata (id, title, metadata); nulls keep what is there."""
        self.store.replace("sessions", _shaped(S.update_sessions(self.sessions(), changes), SESSIONS))

    def delete_sessions(self, doomed: DataFrame) -> None:
        """Remove sessions (id), their messages and working sets."""
        doomed = stage(doomed.select("id"), "doomed")
        tables = {"sessions": (self.sessions(), SESSIONS), "messages": (self.messages(), MESSAGES), "working_sets": (self.working_sets(), WORKING_SETS)}
        for name, left in S.delete_sessions({n: df for n, (df, _) in tables.items()}, doomed).items():
            self.store.replace(name, _shaped(left, tables[name][1]))

    def recent_sessions(self, n: int, per_user: bool = False) -> DataFrame:
        return S.recent_sessions(self.sessions(), n, per_user)

    # ---- messages
    def messages(self) -> DataFrame:
        return self.store.read("messages", MESSAGES)

    def add_messages(self, rows: DataFrame) -> DataFrame:
        """Add messages (id, session_id, role, content, ...) with the numbers that follow those in use, by
        time and id. Rows of unknown sessions or roles, without an id, and ids that are there are left
        out. Returns what was added."""
        known = self.sessions().select(F.col("id").alias("session_id"))
        new = _shaped(rows, MESSAGES).filter(F.col("id").isNotNull() & valid_role(F.col("role"))).join(known, "session_id", "left_semi")
        new = new.join(self.messages().select("id"), "id", "left_anti")
        new = new.groupBy("id").agg(F.min(F.struct(*[c for c in new.columns if c != "id"])).alias("r")).select("id", "r.*")
        held = self.messages().select("session_id", "sequence_number")
        numbered = S.appended_numbers(held, new.drop("sequence_number"))
        if self.first_number:
            empty = numbered.join(held.select("session_id").distinct().withColumn("begun", F.lit(0)), "session_id", "left")
            numbered = empty.withColumn("sequence_number", F.col("sequence_number") + F.when(F.col("begun").isNull(), self.first_number).otherwise(0)).drop("begun")
        added = stage(_shaped(numbered, MESSAGES), "added")
        self.store.append("messages", added)
        self._touch(added)
        return added

    def _touch(self, added: DataFrame) -> None:
        last = added.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("t"))
        rows = self.sessions().join(last, "id", "left").withColumns({c: F.greatest(c, "t") for c in ("last_message_at", "updated_at")})
        self.store.replace("sessions", _shaped(rows, SESSIONS))

    # ---- working sets
    def working_sets(self) -> DataFrame:
        return self.store.read("working_sets", WORKING_SETS)

    def associate(self, sets: DataFrame) -> DataFrame:
        """Add working sets (message_id, session_id, query, text, citations, tokens_used, context_hash,
        created_at) with their texts. The id comes from message and contents. Returns what was added."""
        citations = F.col("citations") if dict(sets.dtypes)["citations"] == "string" else F.to_json("citations")
        number = F.sha2(F.concat_ws("|", "message_id", "context_hash"), 256)
        added = stage(_shaped(sets, WORKING_SETS, id=number, citations=citations), "sets")
        self.store.append("working_sets", added)
        return added

    def add_user_messages(self, rows: DataFrame) -> DataFrame:
        """Add user messages (id, session_id, content, created_at[, budget]), compile each text and store
        the working set with its message. Returns the working sets."""
        budget = F.col("budget").cast("long") if "budget" in rows.columns else F.lit(None).cast("long")
        budgets = rows.select("id", budget.alias("budget")).groupBy("id").agg(F.max("budget").alias("budget"))
        added = self.add_messages(rows.withColumn("role", F.lit("user")))
        asked = added.join(budgets, "id").select(F.col("id").alias("query_id"), F.col("content").alias("query"), "budget")
        sets = self.compiler.compile(asked).withColumnRenamed("query_id", "message_id")
        return self.associate(sets.join(added.select(F.col("id").alias("message_id"), "session_id", "created_at"), "message_id"))

    # ---- reading back
    def history(self, most: int | None = None) -> DataFrame:
        return S.conversation_history(self.messages(), most)

    def replay(self) -> DataFrame:
        return S.replay(self.messages(), self.working_sets())

    def full(self) -> DataFrame:
        """(id, title, n_messages, messages, working_sets): each session with all that belongs to it."""
        entry = F.struct("created_at", F.col("id").alias("working_set_id"), "message_id", "context_hash")
        sets = self.working_sets().groupBy(F.col("session_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("working_sets"))
        return S.session_full(self.sessions(), self.messages()).join(sets, "id", "left")
