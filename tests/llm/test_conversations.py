"""Conversations against a plain fold, over any number of partitions."""

import json
import random
from datetime import datetime, timedelta

import pytest

from docketspark.llm import conversations as cv
from docketspark.llm.messages import decode, spoken_text

SCHEMA = "id string, chat_id string, role string, content string, created_at timestamp, speaker string"
T0 = datetime(2024, 1, 1)


def brute(rows):
    seen = {}
    who = lambda r: "user" if r in ("user", "Human ") else "assistant" if r in ("assistant", "AI") else "other" if r == "system" else None
    for i, chat, role, content, at, _ in rows:
        if chat is not None and who(role) != "other":
            seen[i] = (chat.strip().lower(), who(role), *spoken_text(content), at)
    chats = {}
    for i, (chat, role, text, broken, at) in seen.items():
        chats.setdefault(chat, []).append((at, role, text or "", broken, i))
    out = set()
    for chat, m in chats.items():
        if any(at is None or role is None or broken or not text.strip() for at, role, text, broken, _ in m):
            continue
        m.sort(key=lambda x: (x[0], x[1] != "user", x[4]))
        kept = [x for k, x in enumerate(m) if not k or m[k - 1][1:3] != x[1:3]]
        if len(kept) % 2 or any(x[1] != ("user", "assistant")[k % 2] for k, x in enumerate(kept)):
            continue
        out |= {(chat, min(kept[k][4], kept[k + 1][4]), max(kept[k][4], kept[k + 1][4])) for k in range(0, len(kept), 2)}
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 16)])
def test_random_logs(spark, seed, parts):
    r = random.Random(seed)
    rows = []
    for c in range(60):
        at, chat = T0, r.choice(["c%d", " C%d\t"]) % c
        for k in range(r.randrange(1, 7) * 2 if c else 150):
            if r.random() < 0.9:
                at += timedelta(seconds=r.choice([0, 1, 5]))
            role = ["user", "assistant"][k % 2]
            role = r.choice([role, role, {"user": "Human ", "assistant": "AI"}[role]])
            text = f"tekst {k}" if r.random() < 0.5 else json.dumps([{"type": "content", "text": f"tekst {k}"}])
            if c % 7 == 3 and r.random() < 0.2:
                role, text = r.choice([("???", text), (role, " "), (role, '[{"type":"con'), (None, text), ("system", text)])
            row = (f"m{c}-{k:03d}", chat, role, text, None if c % 11 == 5 and k == 1 else at, None)
            rows += [row] * r.choice([1, 1, 1, 2])
            if r.random() < 0.15:
                rows.append((f"m{c}-{k:03d}r", chat, role, text, row[4], None))
    rows += [("lost", None, "user", "x", T0, None), (None, "c1", "user", "x", T0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(x) for x in cv.question_replies(cv.conversations(cv.fold_events(df), parts)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([x for x in rows if x[0]])


def test_edits_deletes_retries(spark):
    rows = [("a", "c", "user", "stare", T0, 1, "create"), ("a", "c", "user", "nowe", T0 + timedelta(hours=1), 2, "edit"), ("b", "c", "assistant", "odp", T0 + timedelta(seconds=1), 1, "create"), ("x", "c", "assistant", "zła", T0 + timedelta(seconds=2), 1, "create"), ("x", "c", "assistant", None, T0 + timedelta(seconds=9), 2, "delete"), ("b", "c", "assistant", "odp", T0 + timedelta(seconds=1), 1, "create")]
    df = spark.createDataFrame(rows, "id string, chat_id string, role string, content string, created_at timestamp, v int, op string")
    turns = cv.conversations(cv.fold_events(df, "v", "op"), 3)
    assert [(r.message_id, r.previous_id, r.n_turns) for r in turns.orderBy("created_at").collect()] == [("a", None, 2), ("b", "a", 2)]


def test_text_and_empty(spark):
    df = spark.createDataFrame([("a", "c", "user", "pytanie", T0, None), ("b", "c", "ai", json.dumps(json.dumps([{"type": "content", "text": "od"}, {"type": "x"}, {"type": "content", "text": "p"}])), T0, None)], SCHEMA)
    out = cv.with_text(cv.conversations(cv.fold_events(df)), df)
    assert {(r.message_id, r.text) for r in out.collect()} == {("a", "pytanie"), ("b", "odp")}
    assert cv.conversations(cv.fold_events(df.limit(0))).count() == 0


def test_decode():
    assert decode("{pilne} tekst")[0] == decode("[1] Pierwsze")[0] == decode('"cytat" i dalej')[0] == decode("")[0] == "plain"
    assert decode('[{"a')[0] == decode('"[{\\"a\\":')[0] == decode("[")[0] == decode('{"type":')[0] == "broken"
    assert decode("[]") == ("json", []) and decode(None)[0] == "null"
    assert spoken_text('{"type":"content","text":"x"}') == ("x", False) and spoken_text("[]") == ("", False)
