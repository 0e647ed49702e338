"""Rebuilding conversations from message rows, read as an event log.

Creates, edits, deletes and re-sent rows of one message fold into its last version with a
partial aggregate; what survives is put in order once, by a range partition over (chat, time,
role, id), so a chat that holds a third of all rows spreads over many tasks.  Neighbours are
compared inside each partition, and a table of partition edges - at most two chats a
partition reach over an edge - carries the last message of one partition to the next.
Validation is a partial aggregate by chat.  No chat is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions.ids import clean_id
from docketspark.llm.messages import spoken_text
from docketspark.operators.ordered import line_up, with_lag, with_lags
from docketspark.session import cut, spread

#: The spellings of roles, in clean form.
USER_NAMES = ["user", "human", "uzytkownik", "użytkownik", "klient", "client", "customer"]
ASSISTANT_NAMES = ["assistant", "ai", "bot", "asystent", "asystentka", "model"]
OTHER_NAMES = ["system", "tool", "function", "developer", "narzędzie", "narzedzie", "systemowy", "systemowa"]


def speaker(role: Column | str) -> Column:
    """'user', 'assistant', 'other' (system and tool messages), or null for what is no known role."""
    r = clean_id(role)
    return F.when(r.isin(USER_NAMES), "user").when(r.isin(ASSISTANT_NAMES), "assistant").when(r.isin(OTHER_NAMES), "other")


#: A character that can be seen: no blank, control or format character.
_SEEN = regex.compile(r"[^\s\p{Z}\p{Cc}\p{Cf}]")


def _digests(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace content by a digest of (speaker, text) and whether the text is whole and not blank."""
    for b in it:
        same, whole = [], []
        for who, content in zip(b.column("speaker").to_pylist(), b.column("content").to_pylist()):
            text, broken = spoken_text(content)
            same.append(blake2b(f"{who}:{text or ''}".encode("utf-8", "replace"), digest_size=16).digest())
            whole.append(not broken and bool(text) and _SEEN.search(text) is not None)
        keep = [n for n in b.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(same, pa.binary()), pa.array(whole, pa.bool_())], [*keep, "_same", "whole"])


def fold_events(df: DataFrame, version: str | None = None, op: str | None = None) -> DataFrame:
    """Last version of each message: message_id, chat_id, speaker, created_at, _same, whole.

    ``version`` names the column that orders the rows of one id (nulls first; none given: all rows are
    one version); rows of the same version are retries, of which the greatest stands.  ``op`` names
    a column that says 'delete' where the row withdraws the message; as the last version it removes
    it.  An edit keeps the earliest created_at of the id, so it does not move in the conversation.
    Rows without a chat_id or id belong to no conversation and are left out, as are system and
    tool messages.  Texts are digested before the shuffle, so only ids and flags move.
    """
    kind = dict(df.dtypes).get(version, "int")
    rows = df.select(
        clean_id("id").alias("message_id"), clean_id("chat_id").alias("chat_id"), speaker("role").alias("speaker"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        (F.col(version) if version else F.lit(0)).alias("_v"), (F.col(op) if op else F.lit("create")).cast("string").alias("_op"), F.col("content"),
    ).where("chat_id IS NOT NULL AND message_id IS NOT NULL AND speaker IS DISTINCT FROM 'other'")
    fields = f"message_id string, chat_id string, speaker string, created_at timestamp, _v {kind}, _op string, _same binary, whole boolean"
    last = spread(rows).mapInArrow(_digests, fields).groupBy("message_id").agg(
        F.max(F.struct("_v", "_same", "whole", "speaker", "chat_id", "_op")).alias("m"), F.min("created_at").alias("created_at")
    )
    return last.where("m._op IS DISTINCT FROM 'delete'").select("message_id", "m.chat_id", "m.speaker", "created_at", "m._same", "m.whole")


def order_messages(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages in conversation order, without repeats of the one before: chat_id, message_id, speaker,
    created_at, usable, previous_id, previous_speaker.

    ``messages`` is what fold_events gives.  Order is created_at (nulls first), at equal times the
    user first, then the id.  A message with the role and text of the one before it is dropped, as
    the earlier stands for both.
    """
    key = F.struct("created_at", F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "assistant", 1).otherwise(2).alias("r"), "message_id")
    usable = F.col("created_at").isNotNull() & F.col("speaker").isNotNull() & F.col("whole")
    seen = messages.select("message_id", "chat_id", "speaker", key.alias("_at"), "_same", usable.alias("usable"))
    lined = line_up(seen, "chat_id", ["_at"], partitions)
    marked = with_lag(lined, "chat_id", ["_at"], F.col("_same"), "_before")
    kept = marked.where(~F.coalesce(F.col("_before") == F.col("_same"), F.lit(False)))
    turns = with_lags(kept, "chat_id", ["_at"], {"previous_id": F.col("message_id"), "previous_speaker": F.col("speaker")})
    return turns.select("chat_id", "message_id", "speaker", F.col("_at.created_at").alias("created_at"), "usable", "previous_id", "previous_speaker")


def kept_chats(turns: DataFrame) -> DataFrame:
    """chat_id and n_turns of the conversations worth keeping.

    All turns usable (time, known speaker, whole text); the first is the user's, each next is the
    other speaker's, the last is the assistant's.
    """
    opening = F.col("previous_id").isNull()
    wrong = F.when(opening, F.col("speaker") != "user").otherwise(F.col("speaker") == F.col("previous_speaker"))
    by = turns.groupBy("chat_id").agg(
        F.count("*").alias("n_turns"),
        F.bool_and(F.coalesce(F.col("usable"), F.lit(False))).alias("_good"),
        F.bool_or(F.coalesce(wrong, F.lit(True))).alias("_wrong"),
        F.count_if(F.col("speaker") == "user").alias("_u"),
        F.count_if(F.col("speaker") == "assistant").alias("_a"),
    )
    return by.where("_good AND NOT _wrong AND _u = _a").select("chat_id", "n_turns")


def conversations(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Turns of the kept conversations: chat_id, n_turns, message_id, speaker, created_at, previous_id, previous_speaker."""
    turns = cut(order_messages(messages, partitions))  # ids and flags only; judged and joined from one table
    return turns.join(kept_chats(turns), "chat_id").drop("usable")


def question_replies(turns: DataFrame) -> DataFrame:
    """(chat_id, message_id_a, message_id_b): each question with its reply, the smaller id first."""
    pairs = turns.where("speaker = 'assistant' AND previous_speaker = 'user'")
    return pairs.select(
        "chat_id", F.least("message_id", "previous_id").alias("message_id_a"), F.greatest("message_id", "previous_id").alias("message_id_b")
    )


def with_text(turns: DataFrame, df: DataFrame) -> DataFrame:
    """Turns with the text of their messages, read from the source rows once more."""
    texts = df.select(clean_id("id").alias("message_id"), "content").mapInArrow(_texts, "message_id string, text string")
    return turns.join(texts.groupBy("message_id").agg(F.max("text").alias("text")), "message_id", "left")


def _texts(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts = (spoken_text(c)[0] for c in b.column("content").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("message_id"), pa.array([t and t.encode("utf-8", "replace").decode() for t in texts], pa.string())], ["message_id", "text"])
