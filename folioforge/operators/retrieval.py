"""Batch retrieval: vector top-k, thresholds, rerank scores, refusals, citations.

Queries are a stated set against all chunks, taken in blocks: both sides are gathered into matrices of bounded size inside
their tasks, every pair of blocks is one matrix product, each task keeps the best k per query, and only those rows are
exchanged. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.catalog import number_within
from folioforge.session import broadcast_if_small, materialize, ship_package, spread

QUERY_BLOCK = 1024
BLOCK_BYTES = 1 << 20
#: Rows a task holds before it goes back to the best k of each query.
KEPT_ROWS = 400_000
#: Query matrices up to this size are sent to every executor, larger ones meet the chunks partition by partition.
BROADCAST_BYTES = 64 << 20
#: Coordinates that bound a score in the SQL form; a method of more compiled terms would be left to the interpreter.
HEAD = 128
#: The SQL form searches one chunk in so many first.
FIRST_PART = 64
#: More than bounds and scores can differ by rounding, for vectors of lengths in ``SOUND``; others are always scored.
MARGIN = 1e-9
SOUND = (1e-70, 1e70)
#: Fixed value: the answer to a refused query.
REFUSAL = "知识库中没有找到与这个问题相关的信息。"


def _allowed(kb_ids: Column, kb: Column) -> Column:
    return F.coalesce(F.size(kb_ids) == 0, F.lit(True)) | F.coalesce(F.array_contains(kb_ids, kb), F.lit(False))


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return rows.select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = 20, exclude: DataFrame | None = None, method: str = "arrow") -> DataFrame:
    """[query_id, rank, id, score] of queries [query_id, vec, kb_ids] over chunks [id, kb_id, doc_id, embedding].

    Null, zero and not finite vectors are skipped on both sides, vectors of different lengths are not compared, a null or
    empty kb list means all. The similarity itself is ranked, ties (to twelve decimals, which hides the order of summing) go
    by id, and the score is then rounded to four. ``exclude`` [doc_id] leaves documents out. ``method``: ``arrow`` multiplies
    matrices, ``sql`` is built-in expressions. Ids may be numbers or texts.
    """
    chunks = chunks if exclude is None else chunks.join(exclude.select("doc_id").distinct(), "doc_id", "left_anti")
    return (_topk_arrow if method == "arrow" else _topk_sql)(queries, chunks, k)


def _headed(df: DataFrame, vec: str, length: str, name: str, width: int) -> DataFrame:
    """Adds the first ``width`` coordinates of the unit vector, missing ones zero, as columns, and the length of what follows them."""
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col(length)), F.lit(0.0))
    rest = F.slice(vec, width + 1, F.greatest(F.size(vec) - width, F.lit(0)))
    units = {f"{name}{i}": share(F.get(vec, F.lit(i))) for i in range(width)}
    return df.withColumns(units | {f"{name}_rest": share(F.sqrt(_dot(rest, rest))), f"{name}_size": F.size(vec)})


def _sql_pairs(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """[query_id, id, vec, qn, embedding, cn]: pairs among which are the k best of each query.

    One chunk in ``FIRST_PART`` is searched first. What scores less than the k-th best there is not among the k best of all, so of the
    whole search only about ``k * FIRST_PART`` rows a query are left to score and sort. Scores are bounded by the first ``HEAD``
    coordinates, as columns, whose products are compiled, and by the lengths of the rests, which are zero for shorter vectors.
    """
    norm = lambda a: F.sqrt(_dot(F.col(a), F.col(a)))
    finite = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    q = queries.select("query_id", "vec", "kb_ids", norm("vec").alias("qn")).filter(finite("qn"))
    c = chunks.select("id", "kb_id", "embedding", norm("embedding").alias("cn")).filter(finite("cn"))
    widest, held = q.agg(F.max(F.size("vec")), F.sum(2 * F.size("vec"))).first()
    width = min(widest or 1, HEAD)
    small = F.broadcast if 8 * (held or 0) <= BROADCAST_BYTES else lambda df: df
    q, c = _headed(q, "vec", "qn", "q", width), spread(_headed(c, "embedding", "cn", "c", width), "id")
    head = reduce(lambda a, b: a + b, (F.col(f"q{i}") * F.col(f"c{i}") for i in range(width)))
    rests = F.col("q_rest") * F.col("c_rest")
    alike = (F.col("q_size") - F.col("c_size") == 0) & _allowed(F.col("kb_ids"), F.col("kb_id"))  # sizes are no key to join by: nearly all are equal
    sound = F.col("qn").between(*SOUND) & F.col("cn").between(*SOUND)
    first = c.filter(F.pmod(F.xxhash64("id"), F.lit(FIRST_PART)) == 0).join(small(q), alike & sound).select("query_id", (head - rests).alias("least"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("least")))
    least = first.withColumn("place", place).filter(F.col("place") == k).select(F.col("query_id").alias("_query"), "least")
    q = q.join(least, F.col("query_id").eqNullSafe(F.col("_query")), "left").withColumn("least", F.coalesce("least", F.lit(-2.0)) - MARGIN)
    return c.join(small(q), alike & (~sound | (head + rests >= F.col("least")))).select("query_id", "id", "vec", "qn", "embedding", "cn")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _topk_sql(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    score = F.round(_dot(F.col("vec"), F.col("embedding")) / (F.col("qn") * F.col("cn")), 12)
    return _top(_sql_pairs(queries, chunks, k).select("query_id", "id", score.alias("score")), k)


def _matrices(df: DataFrame, key: str, label: str, vec: str, rows: int | None = None) -> DataFrame:
    """Usable vectors of equal length gathered into rows [dim, key array, label array, unit] inside their tasks; ``unit`` is the
    matrix of their unit vectors as bytes, at most ``BLOCK_BYTES`` or ``rows`` rows of it."""
    df = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    types = ", ".join(f"{c} array<{df.schema[c].dataType.simpleString()}>" for c in ("key", "label"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v = b.column("vec")
            n = np.asarray(v.value_lengths().fill_null(0))
            flat = v.flatten().to_numpy(zero_copy_only=False)  # null elements become nan
            start = np.cumsum(n) - n
            for dim in np.unique(n[n > 0]):
                at = np.flatnonzero(n == dim)
                for i in range(0, len(at), size := rows or max(1, BLOCK_BYTES // (8 * int(dim)))):
                    own = at[i : i + size]
                    m = flat[start[own, None] + np.arange(dim)]
                    length = np.sqrt((m * m).sum(axis=1))
                    ok = np.isfinite(length) & (length > 0)
                    take = pa.array(own[ok])
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(take)], pa.int32()), b.column(c).take(take)) for c in ("key", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), *lists, pa.array([(m[ok] / length[ok, None]).tobytes()], pa.binary())], ["dim", "key", "label", "unit"])

    return df.mapInArrow(run, f"dim int, {types}, unit binary").filter(F.size("key") > 0)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best finite scores of each column; rows are in the order that settles ties."""
    n = len(scores)
    if n > k:
        least = np.partition(scores, n - k, axis=0)[n - k]
        above, same = scores > least, scores == least
        take = above | same & (np.cumsum(same, axis=0) <= k - above.sum(axis=0))
    else:
        take = np.ones(scores.shape, bool)
    query, row = np.nonzero((take & np.isfinite(scores)).T)
    return query, row


def _topk_arrow(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    ship_package(queries.sparkSession)
    queries = queries.withColumn("kb_ids", F.col("kb_ids").cast("array<string>")).repartition("query_id")
    asked = materialize(_matrices(queries, "query_id", "kb_ids", "vec", QUERY_BLOCK))
    held = _matrices(chunks.withColumn("kb_id", F.col("kb_id").cast("string")), "id", "kb_id", "embedding")
    named = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))
    size = asked.agg(F.sum(F.length("unit"))).first()[0] or 0  # bytes of the query matrices
    pairs = held.crossJoin(F.broadcast(named) if size <= BROADCAST_BYTES else named).filter("dim = q_dim")
    kinds = {c: asked.schema["key"].dataType.elementType.simpleString() if c == "query_id" else held.schema["key"].dataType.elementType.simpleString() for c in ("query_id", "id")}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def best() -> pa.Table:
            t = pa.concat_tables(kept).sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])
            name = t.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(name, prepend=-1))
            place = np.arange(len(name)) - np.repeat(first, np.diff(first, append=len(name)))
            return t.filter(pa.array(place < k))

        for b in parts:
            for i in range(b.num_rows):
                dim = b.column("dim")[i].as_py()
                ids, asks = b.column("key")[i].values, b.column("q_key")[i].values
                order = pc.sort_indices(ids).to_numpy()
                units = (np.frombuffer(b.column(c)[i].as_py(), np.float64).reshape(-1, dim) for c in ("unit", "q_unit"))
                scores = np.round(next(units)[order] @ next(units).T, 12) + 0.0
                kb = np.array(b.column("label")[i].as_py(), object)[order]
                allowed: dict[tuple, list[int]] = {}
                for j, wanted in enumerate(b.column("q_label")[i].as_py()):
                    allowed.setdefault(tuple(wanted or ()), []).append(j)
                for wanted, at in allowed.items():
                    if wanted:
                        scores[np.ix_(~np.isin(kb, [w for w in wanted if w is not None]), at)] = -np.inf
                query, row = _best(scores, k)
                kept.append(pa.table({"query_id": asks.take(pa.array(query)), "id": ids.take(pa.array(order[row])), "score": scores[row, query]}))
                if sum(t.num_rows for t in kept) > KEPT_ROWS:
                    kept = [best()]
                    if kept[0].num_rows > KEPT_ROWS // 2:  # too many queries to hold: what is there is passed on
                        yield from kept.pop().to_batches(65536)
        if kept:
            yield from best().to_batches(65536)

    return _top(pairs.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double"), k)


def retrieve(queries: DataFrame, chunks: DataFrame, disabled: DataFrame | None = None, scores: DataFrame | None = None, k: int = 20, min_score: float = 0.25, top_n: int = 6, method: str = "arrow") -> DataFrame:
    """R2: blank queries find nothing; disabled documents are left out; rerank scores replace scores where there are any;
    what scores at least ``min_score`` stays, at most ``top_n`` a query."""
    asked = queries.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    hits = cosine_topk(asked, chunks, k, disabled, method)
    hits = hits if scores is None else apply_rerank(hits, scores)
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(w))
    return hits.filter(F.col("rank") <= top_n).select("query_id", "rank", "id", "score")


def apply_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores`` [query_id, pos, idx, relevance] in the reranker's order, idx from 0 into a query's hits. Indexes out
    of range are ignored; a query without a usable row keeps its order and scores."""
    s = scores.select("query_id", "pos", (F.col("idx") + 1).alias("rank"), F.round(F.coalesce("relevance", F.lit(0.0)), 4).alias("new"))
    rows = hits.join(s, ["query_id", "rank"], "left").withColumn("any", F.max(F.col("new").isNotNull()).over(Window.partitionBy("query_id")))
    rows = rows.filter(~F.col("any") | F.col("new").isNotNull())
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("pos", "rank")))
    return rows.select("query_id", order.alias("rank"), "id", F.coalesce("new", "score").alias("score"))


def refusal_guard(queries: DataFrame, hits: DataFrame, chunks: DataFrame, answer: str = REFUSAL) -> DataFrame:
    """[query_id, refused, answer] (R4): a strict query without hits, or whose kbs hold no chunk, is refused; a null or empty
    kb list means all."""
    n_hits = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    per_kb = chunks.groupBy(F.col("kb_id").cast("string").alias("kb")).agg(F.count(F.lit(1)).alias("n"))
    held = queries.select("query_id", F.explode("kb_ids").alias("kb")).withColumn("kb", F.col("kb").cast("string")).join(per_kb, "kb").groupBy("query_id").agg(F.sum("n").alias("n_chunks"))
    every = per_kb.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"))  # one row
    rows = queries.join(n_hits, "query_id", "left").join(held, "query_id", "left").crossJoin(F.broadcast(every))
    n_chunks = F.when(F.coalesce(F.size("kb_ids"), F.lit(0)) <= 0, F.col("n_all")).otherwise(F.coalesce("n_chunks", F.lit(0)))
    refused = F.col("strict") & ((F.coalesce("n_hits", F.lit(0)) == 0) | (n_chunks == 0))
    return rows.select("query_id", refused.alias("refused"), F.when(refused, answer).alias("answer"))


def citations(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The hits' chunks with document names and all that is needed to open them again: [query_id, idx, doc_id, kb_id, doc_name,
    artifact, section_num, breadcrumb, anchor, text, score]. idx counts from 1, texts are cut to 160, a missing name is the id, missing
    texts are empty."""
    names = docs.select(F.col("id").alias("doc_id"), F.col("name").alias("doc_name"))
    rows = hits.join(chunks, "id").join(names, "doc_id", "left")
    shown = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    name = F.coalesce("doc_name", F.col("doc_id").cast("string")).alias("doc_name")
    return rows.select("query_id", F.col("rank").alias("idx"), "doc_id", "kb_id", name, "artifact", *map(shown, ("section_num", "breadcrumb", "anchor")), F.left(F.coalesce("text", F.lit("")), F.lit(160)).alias("text"), "score")


def context_text(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """[query_id, context]: ``[i] 【document head】`` and the text of each hit, in order. The head is the breadcrumb, else the section's
    number, else nothing, and a blank stands before it in any case; a document without a name is called 文档."""
    names = docs.select(F.col("id").alias("doc_id"), F.col("name").alias("doc_name"))
    rows = hits.join(chunks, "id").join(names, "doc_id", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    head = F.coalesce(some("breadcrumb"), some("section_num"), F.lit(""))
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 【"), F.coalesce("doc_name", F.lit("文档")), F.lit(" "), head, F.lit("】\n"), F.coalesce("text", F.lit("")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("x")))), lambda r: r.x), "\n\n").alias("context"))


def number_fragments(frags: DataFrame, key: str = "anchor") -> DataFrame:
    """Adds n (R6) to [session_id, seq, doc_id, anchor]: a known anchor keeps its number, an empty one is always new.
    ``key='doc_anchor'`` tells equal anchors of two documents apart. The first place of each key is an aggregate, the keys are
    numbered over ranges and joined back, so no session meets in one task."""
    own = F.when(F.coalesce("anchor", F.lit("")) == "", F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    named = F.col("anchor") if key == "anchor" else F.concat_ws("\u0000", F.col("doc_id").cast("string"), "anchor")
    rows = frags.withColumn("_key", F.coalesce(own, F.concat(F.lit("a:"), named)))
    first = rows.groupBy(F.col("session_id").alias("_session"), F.col("_key").alias("_anchor")).agg(F.min("seq").alias("_first"))
    numbers = number_within(first, "n", "_session", "_first", "_anchor")
    same = F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_key") == F.col("_anchor"))
    return rows.join(broadcast_if_small(numbers.select("_session", "_anchor", F.col("n").cast("int").alias("n"))), same).select(*frags.columns, "n")


def embed(df: DataFrame, text: str, fn: Callable[[list[str]], list[list[float]]], batch: int = 8, out: str = "embedding") -> DataFrame:
    """A caller's function over batches of texts, order kept; a different number of vectors is an error."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        vecs: list = []
        for i in range(0, len(s), batch):
            part = s.iloc[i : i + batch].fillna("").tolist()
            got = fn(part)
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
            vecs.extend(got)
        return pd.Series(vecs, index=s.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def hashing_embedder(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: counts of words by CRC bucket."""
    from zlib import crc32

    def fn(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.split(" "):
                v[crc32(w.encode()) % dim] += 1.0
            out.append(v)
        return out

    return fn
