"""Conversation logs: history, branches, edits, segments. Messages are [session_id, seq, role, content, ..]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import strip
from folioforge.operators.catalog import number_rows


def history(messages: DataFrame, n: int = 12) -> DataFrame:
    """All but the newest message, the last ``n`` of those, then the user and assistant ones with content (H1)."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    rows = messages.withColumn("_b", back).filter(F.col("_b").between(2, n + 1)).drop("_b")
    return rows.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))


def branch(messages: DataFrame, cuts: DataFrame, inclusive: bool = True) -> DataFrame:
    """Messages copied into new sessions up to a cut [session_id, cut_seq, new_id] (H2); ids are hashes."""
    rows = messages.join(cuts, "session_id").filter(F.col("seq") <= F.col("cut_seq") if inclusive else F.col("seq") < F.col("cut_seq"))
    new = F.sha2(F.concat_ws("|", "new_id", F.col("session_id").cast("string"), F.col("seq").cast("string")), 256)
    return rows.withColumns({"id": new, "session_id": F.col("new_id")}).select("id", *messages.columns)


def branch_title(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("title", F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit("会话")), F.lit("（分支）")))


def truncate_after(messages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, rejected[session_id, edit_seq]) (H3): a user message gets new content and later ones go; an edit whose
    target is missing or not a user's is rejected."""
    target = messages.filter("role = 'user'").select("session_id", F.col("seq").alias("edit_seq"))
    ok = edits.join(target, ["session_id", "edit_seq"], "left_semi")
    rows = messages.join(ok, "session_id", "left").filter(F.col("edit_seq").isNull() | (F.col("seq") <= F.col("edit_seq")))
    content = F.when(F.col("seq") == F.col("edit_seq"), F.col("new_content")).otherwise(F.col("content"))
    return rows.withColumn("content", content).select(messages.columns), edits.join(target, ["session_id", "edit_seq"], "left_anti").select("session_id", "edit_seq")


def merge_segments(deltas: DataFrame) -> DataFrame:
    """[session_id, segment, kind, text] (H4): adjacent deltas [session_id, seq, kind, delta] of one kind are one segment; tool
    segments never merge."""
    w = Window.partitionBy("session_id").orderBy("seq")
    new = (F.col("kind") == "tool") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))
    rows = deltas.withColumn("segment", F.sum(new.cast("int")).over(w) - 1)
    parts = F.sort_array(F.collect_list(F.struct("seq", "delta")))
    return rows.groupBy("session_id", "segment", "kind").agg(F.array_join(F.transform(parts, lambda x: x.delta), "").alias("text"))


TOOLS = "array<struct<callId: string, id: string, name: string, arguments: string, result: string>>"


def legacy_segments(messages: DataFrame) -> DataFrame:
    """Adds segments (H5) to messages with reasoning, tool_calls (JSON) and content: thinking, one tool per call, text."""
    seg = lambda kind, text=None, call=None, name=None, args=None: F.struct(
        F.lit(kind).alias("kind"), *((F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("text", text), ("call_id", call), ("name", name), ("args", args)))
    )
    calls = F.coalesce(F.from_json("tool_calls", TOOLS), F.array().cast(TOOLS))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    tools = F.transform(calls, lambda t, i: seg("tool", None, F.coalesce(F.nullif(t.callId, F.lit("")), F.nullif(t.id, F.lit("")), F.concat(F.lit("legacy-"), i.cast("string"))), F.coalesce(t["name"], F.lit("")), t.arguments))
    kept = lambda test, s: F.when(test, F.array(s)).otherwise(F.slice(F.array(s), 1, 0))
    return messages.withColumn("segments", F.concat(kept(some(F.col("reasoning")), seg("thinking", F.col("reasoning"))), tools, kept(some(F.col("content")), seg("text", F.col("content")))))


def title_source(messages: DataFrame) -> DataFrame:
    """[session_id, source, default_title] (H6): the first user message, trimmed, cut to 600; the default is its first 24."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", "seq").alias("c"))
    text = strip(F.coalesce("c", F.lit("")))
    return first.filter(text != "").select("session_id", F.left(text, F.lit(600)).alias("source"), F.left(text, F.lit(24)).alias("default_title"))


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with their place in the listing, from 1: newest ``updated_at`` first, then id (H6)."""
    return number_rows(sessions, "place", F.desc("updated_at"), "id")
