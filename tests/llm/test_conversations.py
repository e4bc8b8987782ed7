from weft.llm import conversations as C

M = "id string, session_id string, role string, content string, metadata string, sequence_number int, created_at timestamp, conversation_id string, speaker string, fault int"
ALIAS = [("user", "user"), ("human", "user"), ("assistant", "assistant"), ("system", "system"), ("tool", "tool")]


def frames(spark, messages, sessions=("s",)):
    import datetime as dt

    base = dt.datetime(2025, 1, 1)
    rows = [(i, s, r, c, m, q, None if t is None else base + dt.timedelta(seconds=t), "x", "y", 1) for i, s, r, c, m, q, t in messages]
    return spark.createDataFrame(rows, M), spark.createDataFrame([(s, "t") for s in sessions], "id string, title string"), spark.createDataFrame(ALIAS, "alias string, role string")


def sound(spark, messages, sessions=("s",)):
    return [tuple(r) for r in C.sound_turns(*frames(spark, messages, sessions)).orderBy("session_id", "turn_no").collect()]


def test_sound_conversation_with_copies_and_tools(spark):
    rows = [
        ("a", "s", "system", "be kind", None, 0, 5), ("b", "s", " Human ", "hi", None, 1, 6), ("b2", "s", "USER", "hi", None, 1, 9), ("t", "s", "tool", "x", None, 2, 7),
        ("c", "s", "Assistant", "hello", "{broken", 3, 8), ("b", "s", " Human ", "hi", None, 1, 6),
    ]
    assert sound(spark, rows) == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "t"), ("s", 3, "c")]


def test_order_by_time_if_a_number_is_missing(spark):
    assert sound(spark, [("a", "s", "user", "q", None, None, 1), ("b", "s", "assistant", "a", None, 0, 2)]) == [("s", 0, "a"), ("s", 1, "b")]


def test_faults(spark):
    ok = [("user", "q", 0, 1), ("assistant", "a", 1, 2)]
    talks = {
        "ok": ok,
        "from one": [("user", "q", 1, 1), ("assistant", "a", 2, 2)],
        "from two": [("user", "q", 2, 1), ("assistant", "a", 3, 2)],
        "gap": ok[:1] + [("assistant", "a", 2, 2)],
        "collision": ok[:1] + [("assistant", "a", 0, 2)],
        "blank": ok[:1] + [("assistant", "\u3000\t", 1, 2)],
        "null": ok[:1] + [("assistant", None, 1, 2)],
        "stranger": ok[:1] + [("moderator", "a", 1, 2)],
        "nobody": ok[:1] + [(None, "a", 1, 2)],
        "tool only": ok[:1] + [("tool", "a", 1, 2)],
        "open end": ok + [("user", "q", 2, 3)],
        "two questions": [("user", "q", 0, 1), ("user", "q2", 1, 2), ("assistant", "a", 2, 3)],
        "answer first": [("assistant", "q", 0, 1), ("user", "a", 1, 2), ("assistant", "a", 2, 3)],
        "system only": [("system", "q", 0, 1)],
    }
    rows = [(f"{name}-{k}", name, r, c, None, q, t) for name, talk in talks.items() for k, (r, c, q, t) in enumerate(talk)]
    assert {s for s, _, _ in sound(spark, rows + [("z", "unknown session", "user", "q", None, 0, 1), ("z2", "unknown session", "assistant", "q", None, 1, 1)], tuple(talks))} == {"ok", "from one"}


def test_threads_without_session(spark):
    rows = [
        ("a", None, "user", "q", None, None, 1), ("b", None, "assistant", "a", '{"reply_to": "a"}', None, 2), ("c", None, "user", "q", '{"quotes": "b"}', None, 3),
        ("d", None, "assistant", "z", '{"reply_to": "c"}', None, 4), ("e", None, "user", "alone", '{"reply_to": "nobody"}', None, 5),
    ]
    messages, _, aliases = frames(spark, rows)
    got = {r.conversation_id: (r.n_messages, r.fault) for r in C.reports(messages, aliases).collect()}
    assert got == {"thread:a": (4, "sound"), "thread:e": (1, "missing reply")}
    assert sound(spark, rows) == []


def test_empty(spark):
    assert sound(spark, []) == []
