import random

import pytest

from weft.llm import encoding as E, mixing as X, sentences as S


def test_ids_equal_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    enc = E.encoder()
    own = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", " ", "Hello  world!\n\n", "<|endoftext|>", "naïve café — 日本語 ไทย 🧭👩‍🔧", "a" * 5000, "ab" * 3000]
    texts += ["".join(rng.choice("abc ABC.,\n\t019日本ก🙂'") for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    texts += ["".join(rng.choice(al) for _ in range(3000)) for al in ("xy", "abcdefgh", "ไทย", "!?.")]
    for t in texts:
        assert enc.encode(t) == own.encode_ordinary(t), t[:60]


def test_rank_queue_is_ordered():
    rng = random.Random(3)
    queue, want = E.RankQueue(50_256), []
    for _ in range(3000):
        if rng.random() < 0.6 or not want:
            x = (rng.randrange(50_256), rng.randrange(10**6))
            queue.push(*x)
            want.append(x)
        else:
            want.sort()
            assert queue.pop() == want.pop(0)
    while want:
        want.sort()
        assert queue.pop() == want.pop(0)
    assert queue.pop() is None


def test_encode_rows(spark):
    shape = "doc_id long, text string, ids int, lang string"
    got = {r.doc_id: r.ids for r in E.encode(spark.createDataFrame([(1, "Hello", 0, "en"), (2, "", 0, None), (3, None, 0, None)], shape)).collect()}
    assert got == {1: [15496], 2: [], 3: []}
    assert E.encode(spark.createDataFrame([], shape)).count() == 0


def test_seats_by_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.random() * rng.choice([0, 1, 100]) for _ in range(rng.randrange(1, 9))]
        seats, want = rng.randrange(0, 200), [0] * len(w)
        if sum(w):
            for _ in range(seats):
                want[max(range(len(w)), key=lambda i: (w[i] / (2 * want[i] + 1), -i))] += 1
        assert X.sainte_lague(w, seats) == want


def test_mix_reaches_shares(spark):
    rng = random.Random(5)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(5, 60))), rng.choice(["Big ", "big", "small", "other", None]) if i > 60 else "small", 3) for i in range(900)]
    docs += [(5000, None, "big", 1), (5001, "", "small", 1)]
    targets = [("big", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    for shard in (20_000, 50):
        taken = X.mix(d, t, shard=shard)
        rows = taken.collect()
        assert {r.source for r in rows} == {"big", "small"} and len({r.doc_id for r in rows}) == len(rows)
        assert all(1 <= r.copies <= {"big": 1, "small": 2}[r.source] for r in rows)
        got = {r.source: r for r in X.report(taken, t).collect()}
        assert abs(got["big"].actual_share - 2 / 3) < 0.01 and got["absent"].tokens == 0
    assert X.mix(d.limit(0), t).count() == 0 and X.mix(d, t.limit(0)).count() == 0


SENTENCES = {
    "Dr. K. Smith left. It was 5 p.m. He ran at 3.14 km/h.": 3,
    'He said "fine. rarely, though" and left. Next one!': 2,
    "She wrote: “It works.” “Is it ready?” they asked. (All of it is.) Done": 4,
    "It holds spans, etc. merge_column() ran, cf. a replay.": 2,
    "We sold it to Juniper Inc. It reads Osprey Bros. files.": 2,
    "Die Sitzung kürzt z. B. den Zähler. Am 27. Mai prüft Nr. 5 das Archiv.": 2,
    "„Fertig?“, fragte Dr. Korvash. Im 3. Schritt sperrt es.": 2,
    "« C'est prêt ? » demande Mme Quimdax. La file trie 6,5 % de la plage !": 2,
    "¿Por qué? «¿Está listo?», preguntó la Dra. Zintara. Véase la pág. 27.": 3,
    "«Готово?» — спросил г. Варнхолт. В 2024 г. список режет 4,5 тыс. строк и т. д. после сбоя.": 2,
    "「準備できた。」と担当者は言った。本当に？！図（図28を参照。）は固定する……。": 3,
    "“可以合并了。”会话的维护者说。快照……真的吗？！《指南。第3卷》锁定。": 4,
    "डॉ. मारोवी सूची को गिनता है। “क्या यह है?” समीक्षक ने पूछा।": 2,
    "قال د. مروبي: «يقص القائمة». لماذا يغلق؟ يعد 3.14 من النسخة!": 3,
    "คิวนับสำเนา14ครั้ง ทำไมคิวจึงย้าย บันทึกย้าย": 3,
    "# Head 1.2\nText one. Text two.\n\n```\na. B. C.\n\nd\n```\n- item one. More.\n2. item": 7,
    "No. 5 is alive. No. It is not.": 3,
    "A line\nthat wraps. Another\nline": 2,
    "no end\n\nnext": 2,
    "": 0,
    " \n\t ": 0,
}


@pytest.mark.parametrize("text", SENTENCES)
def test_sentences(text):
    got = S.sentences(text)
    assert len(got) == SENTENCES[text], [text[a:b] for a, b in got]
    assert all(text[a:b] == text[a:b].strip() for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_chunks_compose_to_the_same():
    rng = random.Random(6)
    for n in (5000, 9001):
        symbols = [rng.randrange(len(S.SYMBOLS)) for _ in range(n)]
        assert S.transduce(symbols) == S._run(symbols, S.START)


def test_long_text_equals_its_parts():
    part = 'One (two. three) "four. five" six. Seven? eight.\n\n'
    assert len(S.sentences(part * 3000)) == 3000 * len(S.sentences(part))


def test_find_sentences_rows(spark):
    shape = "doc_id long, text string, start_pos int"
    rows = [(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "", 0), (None, "x", 0)]
    got = sorted(tuple(r) for r in S.find_sentences(spark.createDataFrame(rows, shape)).collect())
    assert got == [(1, 0, 4), (1, 5, 9)]
    assert S.find_sentences(spark.createDataFrame([], shape)).count() == 0


def test_brackets_nest_to_any_depth():
    from weft.llm.sentences import sentences

    for a, b in ("()", "«»", "「」"):
        for n in (2, 3, 9):
            text = f"He said {a * n}deep{b * (n - 1)} Still inside. Not out yet{b} and here. Then more."
            assert [text[x:y] for x, y in sentences(text)] == [text[:-11], "Then more."], (a, n)


def test_abbreviations_outside_the_lists_of_one_corpus():
    one = ["Then Gov. Newsom spoke.", "Sen. Warren and Rep. Smith met.", "The Dept. Chair came.", "See Bldg. Seven today.", "Adm. Kirk and Lt. Cmdr. Data left.", "Roe v. Wade was argued.", "En janv. Paris brille.", "We saw St. Paul there."]
    for text in one:
        assert S.sentences(text) == [(0, len(text))], text
    assert len(S.sentences("He lives on Main St. Paul agrees.")) == 2


def test_abbreviations_are_learned(spark):
    rows = [(i, f"The qty. of part {i} is low. It rose by appr. five now. Good zord. Then zord. Next.") for i in range(8)] + [(99, None), (98, "")]
    learned = S.learn_abbreviations(spark.createDataFrame(rows, "doc_id long, text string"))
    assert learned == {"qty", "appr"}
    assert len(S.sentences("The appr. Value is known. Ok.")) == 3 and len(S.sentences("The appr. Value is known. Ok.", learned)) == 2


def test_time_is_linear_in_one_block():
    import time

    took = []
    for n in (20_000, 80_000):
        text = "Here it is, e.g. in one block, by Dr. Who. " * n
        began = time.process_time()
        S.sentences(text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


def test_parts_of_long_texts(spark, monkeypatch):
    text = "One. Two (a. b.) three.\n- item 1. More\n- item 2\n\n```\na. b.\n\nc\n```\n# Head\nwrapped\nline. End.\n\n" * 40
    whole = S.sentences(text)
    cut = [(o + a, o + b) for o, part in S.parts(text, 100) for a, b in S.sentences(part)]
    assert cut == whole and len(list(S.parts(text, 100))) > 20
    monkeypatch.setattr(S, "PART", 500)
    got = sorted((r.start_pos, r.end_pos) for r in S.find_sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert got == whole


def test_shares_are_met_by_exchange():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(200):
        t, most = r.integers(1, 500, int(r.integers(30, 90))), int(r.integers(1, 4))
        quota = float(r.uniform(2000, t.sum() * most))
        copies = X.taken(t, quota, most)
        assert (copies >= 0).all() and (copies <= most).all() and abs((copies * t).sum() - quota) <= 0.005 * quota
    assert X.taken(np.array([5, 7]), 0.0, 2).tolist() == [0, 0] and X.taken(np.array([5, 7]), 24.0, 2).tolist() == [2, 2]
