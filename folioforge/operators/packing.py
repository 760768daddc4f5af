"""Token-window packing: in order, nothing split, an oversize item alone.

Greedy packing is sequential, so one small Arrow helper turns an array of weights into window numbers; documents stay one
row each until then, and nothing is shuffled for it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import SPACE, estimate_tokens, is_blank, let, num_of, tail_by_tokens
from folioforge.operators.lines import explode_lines, heading_lines, recent_headings
from folioforge.session import materialize, ship_package


def _greedy(weights, cap: int, joiner: int) -> list[int]:
    out, window, used, any_ = [], 0, 0, False
    for w in weights:
        if any_ and used + w > cap:
            window, used, any_ = window + 1, 0, False
        used += w + (joiner if any_ else 0)
        any_ = True
        out.append(window)
    return out


def pack(weights: Column, cap: int, joiner: int = 0) -> Column:
    """Window number of each weight, from 0 (P1); ``joiner`` is what each further item of a window adds."""

    @F.pandas_udf("array<int>")
    def run(w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _greedy(x, cap, joiner) for x in w], dtype=object)

    return run(weights)


def _table(weights, cap: int, joiner: int) -> tuple[list[int], list[int], list[int], int]:
    """What a stretch of weights does to any window it is entered with: (need, windows, used, total). Entered with ``u``
    used, the first item with need > cap - u opens a window; from there ``windows`` open, the last with ``used``. Without
    such an item ``total`` is added. Items beyond the first that overflows an empty window need no entry."""
    n, far = len(weights), 0
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w + joiner)
    ahead = []
    for i in range(n):
        far = max(far, i + 1)
        while far < n and sums[far] - sums[i] - joiner + weights[far] <= cap:
            far += 1
        ahead.append(far)
    opened, used = [0] * n, [0] * n
    for i in reversed(range(n)):
        j = ahead[i]
        opened[i], used[i] = (1, sums[n] - sums[i] - joiner) if j == n else (1 + opened[j], used[j])
    need, at = [], []
    for i, w in enumerate(weights):
        if not need or sums[i] + w > need[-1]:
            need.append(sums[i] + w)
            at.append(i)
        if need[-1] > cap:
            break
    return need, [opened[i] for i in at], [used[i] for i in at], sums[-1]


def _entries(tables, cap: int) -> list[dict]:
    """Window number and use at the start of each stretch of a key, from the tables in order; -1 before the first item."""
    out, window, used = [], -1, 0
    for t in tables:
        out.append({"p": t["p"], "window": window, "used": used})
        j = 0 if window < 0 else bisect_right(t["need"], cap - used)
        if j < len(t["need"]):
            window, used = window + t["windows"][j], t["used"][j]
        else:
            used += t["total"]
    return out


def _from(weights, window: int, used: int, cap: int, joiner: int) -> list[int]:
    out = []
    for w in weights:
        if window < 0 or used + w > cap:
            window, used = window + 1, w
        else:
            used += w + joiner
        out.append(window)
    return out


def pack_windows(df: DataFrame, key: str, order: str, weight: Column, cap: int, joiner: int = 0, whole: int = 50_000) -> DataFrame:
    """``df`` with window_id: rows of a key packed in order (P1, P2). Give it no more columns than are asked for.

    A key may have any number of rows: where one has more than ``whole``, rows lie in ranges by key and order. Each stretch is
    summed up as the windows it makes of any start; the few tables of a key give the true starts, and the stretches are packed
    from those. Where all keys are smaller, a key is one stretch. Weights are taken once, before either.
    """
    cols = [c for c in df.columns if c != key]
    ship_package(df.sparkSession)
    rows = materialize(df.withColumn("_w", weight))
    large = not rows.groupBy(key).count().filter(F.col("count") > whole).isEmpty()
    rows = materialize(rows.repartitionByRange(key, order).withColumn("_p", F.spark_partition_id())) if large else rows.withColumn("_p", F.lit(0))
    held = rows.groupBy(F.col(key).alias("_key"), "_p").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.col("_w"), F.struct(*cols).alias("_r")))).alias("a"))
    weights = F.transform("a", lambda x: x["_w"])

    @F.pandas_udf("need array<bigint>, windows array<bigint>, used array<bigint>, total bigint")
    def tables(w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_table([int(y) for y in x], cap, joiner) for x in w], columns=["need", "windows", "used", "total"])

    @F.pandas_udf("array<struct<p int, window bigint, used bigint>>")
    def entries(t: pd.Series) -> pd.Series:
        return pd.Series([_entries(x, cap) for x in t], dtype=object)

    @F.pandas_udf("array<int>")
    def run(w: pd.Series, window: pd.Series, used: pd.Series) -> pd.Series:
        return pd.Series([_from([int(y) for y in x], a, b, cap, joiner) for x, a, b in zip(w, window, used)], dtype=object)

    if not large:
        held = held.withColumn("w", run(weights, F.lit(-1), F.lit(0)))
        return held.select(F.col("_key").alias(key), F.explode(F.arrays_zip("a", "w")).alias("x")).select(key, "x.a._r.*", F.col("x.w").alias("window_id"))
    starts = held.select("_key", "_p", tables(weights).alias("t")).groupBy("_key").agg(entries(F.sort_array(F.collect_list(F.struct(F.col("_p").alias("p"), "t.need", "t.windows", "t.used", "t.total")))).alias("e"))
    starts = starts.select(F.col("_key").alias("_k"), F.inline("e"))
    held = held.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("p"))).withColumn("w", run(weights, "window", "used"))
    return held.select(F.col("_key").alias(key), F.explode(F.arrays_zip("a", "w")).alias("x")).select(key, "x.a._r.*", F.col("x.w").alias("window_id"))


def _cut(parts: Column, windows: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """``joined(parts of the window, window)`` for every window, in one walk: windows never fall, so each is a slice."""
    starts = F.filter(F.transform(windows, lambda w, i: F.when((i == 0) | (w != F.get(windows, i - 1)), i)), lambda i: i.isNotNull())
    slices = lambda at: F.transform(at, lambda s, k: joined(F.slice(parts, s + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - s), k))
    return let(starts, slices)


def _groups(parts: Column, windows: Column, sep: str) -> Column:
    """The parts of each window joined, in window order."""
    return _cut(parts, windows, lambda own, _: F.array_join(own, sep))


def para_windows(df: DataFrame, target_chars: int) -> DataFrame:
    """[doc_id, ord, text]: paragraphs, split at blank lines, packed up to ``target_chars``."""
    paras = F.filter(F.split("text", rf"\n{SPACE}*\n"), lambda p: ~is_blank(p))
    rows = df.select("doc_id", paras.alias("p")).withColumn("w", pack(F.transform("p", lambda x: F.length(x)), target_chars, 2)).filter(F.size("p") > 0)
    return rows.select("doc_id", F.posexplode(_groups(F.col("p"), F.col("w"), "\n\n")).alias("ord", "text"))


def pass2_items(df: DataFrame, max_tokens: int) -> DataFrame:
    """[doc_id, key, num, content]: a ``##`` section if it fits, else its ``###`` parts, else paragraph windows.

    One exchange by document: lines are grouped once by section and part, and a section is put together from its parts.
    """
    doc, sec = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "o2")
    so_far = Window.unboundedPreceding
    lines = heading_lines(explode_lines(df))
    is_ = lambda k: F.coalesce(F.col("level") == k, F.lit(False)).cast("int")
    lines = lines.withColumn("o2", F.sum(is_(2)).over(doc.orderBy("line_no").rowsBetween(so_far, 0)))
    lines = lines.withColumn("o3", F.sum(is_(3)).over(sec.orderBy("line_no").rowsBetween(so_far, 0)))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line", "level", "title")))
    parts = lines.groupBy("doc_id", "o2", "o3").agg(rows.alias("l"))
    head = F.get("l", F.lit(0))
    starts = F.coalesce(head.level == F.when(F.col("o3") > 0, 3).otherwise(2), F.lit(False))
    parts = parts.select("doc_id", "o2", "o3", F.when(starts, num_of(head.title)).alias("num"), F.array_join(F.transform("l", lambda x: x.line), "\n").alias("content"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o3", "content")).over(sec)), lambda x: x.content), "\n")
    parts = parts.withColumns({"whole": whole, "num2": F.max(F.when(F.col("o3") == 0, F.col("num"))).over(sec), "n3": F.max("o3").over(sec), "n2": F.max("o2").over(doc)})
    parts = parts.withColumn("counts", (F.col("n3") > 0) & ((F.col("o3") > 0) | ~is_blank(F.col("content"))))
    parts = parts.withColumn("n", F.sum(F.col("counts").cast("int")).over(sec))
    parts = parts.filter((F.col("o2") > 0) | (F.col("n2") == 0) | ~is_blank(F.col("whole")))
    fits = lambda c: estimate_tokens(F.col(c)) <= max_tokens
    by_part = ~fits("whole") & (F.col("n") > 1)
    parts = parts.filter(F.when(by_part, F.col("counts")).otherwise(F.col("o3") == 0))
    parts = parts.withColumns({"text": F.when(by_part, F.col("content")).otherwise(F.col("whole")), "num": F.when(by_part, F.col("num")).otherwise(F.col("num2"))})
    paras = F.when(~fits("text"), F.filter(F.split("text", rf"\n{SPACE}*\n"), lambda p: ~is_blank(p)))
    parts = parts.withColumn("p", paras).withColumn("w", pack(F.transform("p", lambda x: F.length(x)), max(1000, int(max_tokens * 1.2)), 2))
    pieces = F.when(F.col("p").isNull(), F.array("text")).when(F.size("p") > 0, _groups(F.col("p"), F.col("w"), "\n\n")).otherwise(F.array().cast("array<string>"))
    out = parts.select("doc_id", "o2", "o3", "num", F.posexplode(pieces).alias("o4", "content"))
    key = F.row_number().over(doc.orderBy("o2", "o3", "o4")) - 1
    return out.select("doc_id", key.alias("key"), "num", "content")


def split_long_pieces(paras: Column, windows: Column) -> Column:
    """Pieces as the original joins them: a piece opened by an overflow starts with its paragraph and a blank line, so a
    second one follows after four line ends and a lone one keeps a trailing blank line."""
    def piece(own: Column, k: Column) -> Column:
        first = F.concat(F.get(own, F.lit(0)), F.when(k > 0, "\n\n").otherwise(""))
        return F.array_join(F.concat(F.array(first), F.slice(own, 2, 1 << 30)), "\n\n")

    return _cut(paras, windows, piece)


def split_long(df: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """[doc_id, ord, text]: a long text cut at exact blank lines into pieces of up to ``max_tokens`` (P5)."""
    paras = F.filter(F.split("text", "\n\n"), lambda p: ~is_blank(p))
    rows = df.select("doc_id", paras.alias("p")).filter(F.size("p") > 0)
    rows = rows.withColumn("w", pack(F.transform("p", estimate_tokens), max_tokens))
    return rows.select("doc_id", F.posexplode(split_long_pieces(F.col("p"), F.col("w"))).alias("ord", "text"))


def window_context(windows: DataFrame, max_summary: int = 30000, tail: int = 15000) -> DataFrame:
    """[doc_id, window_id, summary, headings, tail, body] from [doc_id, window_id, body, output, summary] (P6): what is
    known when a window is worked on: all earlier summaries cut to ``max_summary`` tokens, the last three headings of the
    last two outputs, the end of the last output. The window table has tens of rows a document."""
    w = Window.partitionBy("doc_id").orderBy("window_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = windows.withColumns({
        "past": F.collect_list("summary").over(before),
        "last": F.lag("output").over(w),
        "two": F.array_join(F.collect_list("output").over(w.rowsBetween(-2, -1)), "\n"),
    })
    shown = F.array_join(F.transform("past", lambda x, i: F.concat(F.lit("【"), (i + 1).cast("string"), F.lit("】"), x)), "\n\n")
    heads = recent_headings(rows.select(F.struct("doc_id", "window_id").alias("doc_id"), F.col("two").alias("text"))).select("doc_id.doc_id", "doc_id.window_id", "headings")
    rows = rows.join(heads, ["doc_id", "window_id"], "left")
    return rows.select("doc_id", "window_id", tail_by_tokens(shown, max_summary).alias("summary"), F.coalesce("headings", F.lit("")).alias("headings"), tail_by_tokens(F.coalesce("last", F.lit("")), tail).alias("tail"), "body")
