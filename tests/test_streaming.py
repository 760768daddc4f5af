"""Streams give what their batch twins give, whatever the cuts and restarts."""

import json
import random
import time

from pyspark.sql import functions as F

from folioforge.plans import logs
from folioforge.streaming import blocks, events, trees

OP = "doc_id long, _id long, op string, id string, type string, parent string, props string, text string, nodes string"


def test_a_long_line_in_small_pieces_is_read_once(spark):
    n = 400_000
    d = spark.range(n).selectExpr("1L as doc_id", "id as seq", f"case when id = 0 then '@@tip 1\n' when id = {n - 1} then '\n@@end' when id % 9 = 3 then null else 'abcdefg' end as delta")
    start = time.monotonic()
    r = blocks.read_blocks(d).first()
    assert (r.type, r.target, len(r.content)) == ("tip", "1", 7 * sum(i % 9 != 3 for i in range(1, n - 1))) and time.monotonic() - start < 30


def test_lines_that_only_start_like_a_marker(spark):
    text = "``x\n@ @tip\n@@ x\n@@tip 1\n<!-x\n #a\n@@ END \n <!-- page:1 -->\n@@\n@@end"
    got = {m: [tuple(r) for r in blocks.read_blocks(spark.createDataFrame([(None, 0, text)], "doc_id long, seq int, delta string"), m).collect()] for m in ("pass1", "pass2")}
    assert got == {"pass1": [], "pass2": [(None, 0, "tip", "1", "<!-x\n #a")]}


def test_documents_are_folded_in_batches(spark, sf, capsys):
    folded = events.fold_ops(logs.render_ops(spark, sf))
    folded.explain()
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out
    rows = spark.createDataFrame([(None, 1, "append", "n1", None, None, None, "b", None), (None, 0, "insert", "n1", None, None, None, None, None), (7, 2, "remove", "n1", None, None, None, None, None)], OP)
    assert [tuple(r) for r in events.fold_ops(rows).collect()] == [(None, "n1", None, "root", "{}", "b")]


def ops(rows):
    return [(1, i, *(r.get(k) for k in ("op", "id", "type", "parent", "props", "text", "nodes"))) for i, r in enumerate(rows)]


BASE = [
    {"op": "insert", "id": "n1"}, {"op": "append", "id": "n1", "text": "a"}, {"op": "append", "id": "n1", "text": "b"},
    {"op": "setmd", "id": "n1", "text": "Z"}, {"op": "append", "id": "n1", "text": "c"}, {"op": "append", "id": "n9", "text": "x"},
    {"op": "insert", "id": "n2", "parent": "n1"}, {"op": "update", "id": "n2", "props": '{"k":"v"}'}, {"op": "insert", "id": "n1"},
]


def test_fold_and_every_snapshot_cut(spark):
    df = spark.createDataFrame(ops(BASE), OP)
    want = {(r.id, r.md, r.props) for r in events.fold_ops(df).collect()}
    assert want == {("n1", "Zc", "{}"), ("n2", "", '{"k":"v"}')}
    for cut in (0, 3, 7):
        got = events.apply_after(events.fold_ops(df.filter(F.col("_id") <= cut)), df, cut)
        assert {(r.id, r.md, r.props) for r in got.collect()} == want
    gone = spark.createDataFrame(ops([*BASE, {"op": "remove", "id": "n1"}]), OP)
    assert events.fold_ops(gone).count() == 0
    assert events.fold_ops(spark.createDataFrame(ops([*BASE, {"op": "replace", "nodes": "{}"}]), OP)).count() == 0


def run_stream(spark, stream, out, ckpt, mode="append"):
    def keep(df, n):
        df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def test_fold_stream_with_restarts(spark, sf, tmp_path):
    rows = logs.render_ops(spark, sf)
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for k in range(3):  # each file is one run: the state must survive the restart
        rows.filter(f"_id % 1000 div 334 = {k}").coalesce(1).write.mode("append").parquet(src)
        run_stream(spark, events.fold_ops_stream(spark.readStream.schema(rows.schema).parquet(src)), out, ckpt, "update")
    seen = spark.read.parquet(out)
    last = seen.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    got = {(r.doc_id, r.id, r.md) for r in seen.join(last, ["doc_id", "batch"]).collect()}
    assert got == {(r.doc_id, r.id, r.md) for r in events.fold_ops(rows).collect()}


def test_dedupe_and_drop_report_streams(spark, sf, tmp_path):
    log = logs._log(spark, sf)
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    log.unionByName(log.filter("_id % 7 = 0")).write.parquet(src)
    run_stream(spark, events.replay_stream(spark.readStream.schema(log.schema).parquet(src), "40 days"), out, ckpt)
    got = spark.read.parquet(out)
    assert got.count() == log.count() == got.select("_id").distinct().count()
    q = events.drop_report(spark.readStream.schema(log.schema).parquet(src), delay="1 minute").writeStream.format("memory").queryName("drops").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("drops").agg(F.sum("dropped")).first()[0] == log.count() + log.filter("_id % 7 = 0").count()


def test_blocks_do_not_depend_on_the_cuts():
    text = "junk\n@@tip 1\nA\n\n@@end\n```\n@@summary\nno\n@@end\n```\n@@summary\nyes\n@@END\n@@tip 1\ndup\n@@end\n@@title\nT\n@@end\n@@tip 2\nlast\n@@end"
    rng = random.Random(4)
    for mode, enabled in (("pass1", None), ("pass2", ("tip",)), ("pass2", None)):
        whole = blocks.BlockReader(mode, enabled)
        whole.feed(text)
        whole.flush()
        want = whole.take()
        for _ in range(50):
            r, at, got = blocks.BlockReader(mode, enabled), 0, []
            while at < len(text):
                n = rng.randint(1, 9)
                r.feed(text[at : at + n])
                got += r.take()
                r = blocks.BlockReader(mode, enabled, r.state())
                at += n
            r.flush()
            assert got + r.take() == want
    assert [x[1:] for x in want][0] == ("tip", "1", "A")


def test_block_stream(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    rows = [(1, i, d, i == 4) for i, d in enumerate(["@@ti", "p 1\nA", "\n@@e", "nd\n@@tip 2\nB\n", "@@end"])]
    schema = "doc_id long, seq long, delta string, last boolean"
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run_stream(spark, blocks.blocks_stream(spark.readStream.schema(schema).parquet(src)), out, ckpt)
    assert [tuple(r)[:5] for r in spark.read.parquet(out).orderBy("ord").collect()] == [(1, 0, "tip", "1", "A"), (1, 1, "tip", "2", "B")]


def test_criticality(spark):
    df = spark.createDataFrame([("doc.status",), ("job.x",), ("render.op",), ("session.",), (None,), ("doc.statuses",)], "c string")
    assert [r[0] for r in df.select(events.is_critical(F.col("c"))).collect()] == [True, True, False, True, False, False]


def test_rollback_to_whichever_point_came_last(spark):
    ops_ = spark.createDataFrame([(d, i) for d in ("a", "b", "c", "d") for i in range(1, 13)], "doc_id string, _id long")
    points = spark.createDataFrame([("a", 5, "recovery"), ("a", 10, "window"), ("b", 5, "window"), ("b", 8, "recovery"), ("b", 6, "recovery"), ("c", 3, "window"), ("d", 9, "note")], "doc_id string, _id long, kind string")
    got = events.rollback(ops_, points).groupBy("doc_id").agg(F.max("_id").alias("m"))
    assert {r.doc_id: r.m for r in got.collect()} == {"a": 10, "b": 8, "c": 3}


def test_document_ids_may_be_texts(spark):
    df = spark.createDataFrame(ops(BASE), OP).withColumn("doc_id", F.lit("doc-é"))
    folded = events.fold_ops(df)
    assert {(r.doc_id, r.id, r.md) for r in folded.collect()} == {("doc-é", "n1", "Zc"), ("doc-é", "n2", "")}
    assert events.apply_after(folded, df, 100).filter("doc_id = 'doc-é'").count() == 2
    d = spark.createDataFrame([("x", 0, "@@tip 1\nA\n@@end")], "doc_id string, seq long, delta string")
    assert [tuple(r) for r in blocks.read_blocks(d).collect()] == [("x", 0, "tip", "1", "A")]


def plain_tree(rows):
    """Nodes after the operations, with whole copies at every point."""
    nodes, point = events.new_tree(), None
    for r in rows:
        op = dict(zip(("doc_id", "_id", "op", "id", "type", "parent", "props", "text", "nodes"), r))
        if op["op"] in ("checkpoint", "recovery"):
            point = json.dumps(nodes)
        elif op["op"] == "rollback":
            nodes = nodes if point is None else json.loads(point)
        else:
            events.apply_op(nodes, op)
    return {(i, n["parent"], json.dumps(n["props"], sort_keys=True, separators=(",", ":")), "".join(n["md"])) for i, n in nodes.items()}


def test_tree_stream_with_points_rollbacks_and_restarts(spark, tmp_path):
    rng = random.Random(9)
    rows = {d: [] for d in (1, 2)}
    for d in rows:
        for k in range(240):
            op = rng.choice(["insert"] * 3 + ["append"] * 6 + ["setmd", "update", "remove", "recovery", "checkpoint", "rollback", "rollback"] + ["replace"] * (k % 60 == 0))
            i = f"n{rng.randint(0, 5)}"
            rows[d].append((d, k, op, i, "t", rng.choice([None, "n0", "n1"]), json.dumps({rng.choice("ab"): k}), f"[{k}]", '{"n0":{"type":"t","parent":"root","md":"r"}}' if op == "replace" else None))
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for a, b in ((0, 90), (90, 91), (91, 240)):
            spark.createDataFrame([r for d in rows for r in rows[d][max(a - 5, 0) : b]], OP).coalesce(1).write.mode("append").parquet(src)  # five repeated
            run_stream(spark, trees.fold_tree_stream(spark.readStream.schema(OP).parquet(src)), out, ckpt, "update")
            held = {}
            for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.batch):
                held[r.doc_id, r.id] = None if r.gone else (r.id, r.parent, r.props, r.md)
            for d in rows:
                assert {v for (x, _), v in held.items() if x == d and v} == plain_tree(rows[d][:b]), (d, b)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert spark.read.parquet(out).filter("batch = 1").count() <= 4  # one operation a document changes few nodes


def test_queue_stream_drops_what_the_batch_drops(spark, tmp_path):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"s{i % 5}", i, rng.choice(["doc.status", "render", None])) for i in range(900)]
    schema = "subscriber string, _id long, channel string"
    want = {tuple(r) for r in events.bounded_queue(spark.createDataFrame(rows, schema), 40)[1].collect()}
    assert want == {r for r in rows if sum(x[0] == r[0] and x[1] > r[1] for x in rows) >= 40}
    rng.shuffle(rows)
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    for a, b in ((0, 200), (200, 210), (210, 900)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(src)
        run_stream(spark, events.bounded_queue_stream(spark.readStream.schema(schema).parquet(src), 40), out, ckpt)
    got = [tuple(r)[:3] for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_subscriber_costs_its_cap_a_task(spark):
    df = spark.range(0, 40_000, 1, 8).selectExpr("'hot' as subscriber", "id as _id")
    kept, dropped = events.bounded_queue(df, 50)
    assert sorted(r._id for r in kept.collect()) == list(range(39_950, 40_000)) and dropped.count() == 39_950
    from folioforge.streaming import queues

    plan = queues.newest_ids(df, "subscriber", "_id", 50)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.index("Exchange") < plan.index("MapInArrow")  # the tasks' own choice comes before the exchange (plans read upwards)


def test_an_idle_document_leaves_no_state(spark, tmp_path):
    import time

    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    row = lambda k, op, text=None: (1, k, op, "n", None, None, None, text, None)
    put = lambda *rows: spark.createDataFrame(rows, OP).coalesce(1).write.mode("append").parquet(src)
    put(row(0, "insert"), row(1, "append", "a"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keep = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
    q = trees.fold_tree_stream(spark.readStream.schema(OP).parquet(src), 2000).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", ckpt).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            sizes = [x["numRowsTotal"] for p in q.recentProgress for x in p["stateOperators"]]
            if sizes and max(sizes) > 0 and sizes[-1] == 0:
                break
        assert max(sizes) > 0 and sizes[-1] == 0
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert [(r.id, r.md) for r in spark.read.parquet(out).collect()] == [("n", "a")]
