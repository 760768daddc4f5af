"""The catalogue of knowledge bases and documents: joins, diffs, ordering, reports. Functions give new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import cut_meta_keys, norm_ws
from folioforge.session import broadcast_if_small, materialize

RUNNING = ("parsing", "generating", "fetching")
#: Lines of a block of an overview, bytes of overviews a task writes, bytes of lines that are broadcast, shares of a kb beyond that.
OVERVIEW_LINES, OVERVIEW_BYTES, BROADCAST_BYTES, SHARES = 256, 128 << 20, 64 << 20, 32


def list_kbs(kbs: DataFrame, docs: DataFrame) -> DataFrame:
    """kbs with doc_count, 0 kept, in their order (K1)."""
    n = docs.groupBy(F.col("kb_id").alias("id")).agg(F.count(F.lit(1)).alias("doc_count"))
    return kbs.join(n, "id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0))).orderBy("sort_order", "created_at")


def _filled(json: Column) -> Column:
    """A JSON object with at least one key."""
    return F.coalesce(F.size(F.json_object_keys(json)) > 0, F.lit(False))


def effective_config(docs: DataFrame, kbs: DataFrame, presets: DataFrame, kind: str = "gen") -> DataFrame:
    """[id, config, inherited] (K2): a document's own non-empty config, else the kb's for its doc_type, else the built-in
    one with the first preset of the type's group, else the first preset. Small sides: kbs and presets."""
    col = f"{kind}_config"
    by_type = kbs.select(F.col("id").alias("kb_id"), F.col(col).alias("kb_config"))
    rows = docs.join(by_type, "kb_id", "left")
    inherited = F.try_element_at(F.from_json("kb_config", "map<string,string>"), F.coalesce("doc_type", F.lit("doc")))
    if kind == "gen":
        first = presets.groupBy(F.coalesce("group", F.lit("doc")).alias("doc_type")).agg(F.min_by("id", "ord").alias("own_preset"))
        any_ = presets.agg(F.lit(0).alias("_one"), F.min_by("id", "ord").alias("any_preset"))
        rows = rows.join(broadcast_if_small(first, 10_000), "doc_type", "left").withColumn("_one", F.lit(0)).join(F.broadcast(any_), "_one")
        built_in = F.to_json(F.struct(F.coalesce("own_preset", "any_preset").alias("presetId")))
    else:
        built_in = F.lit('{"components":{"summary":false,"images":false},"plugins":[]}')
    own = _filled(F.col(col))
    config = F.when(own, F.col(col)).when(_filled(inherited), inherited).otherwise(built_in)
    return rows.select("id", config.alias("config"), (~own).alias("inherited"))


INDEX = "enabled boolean, components struct<summary: boolean, images: boolean>, plugins array<string>"


def index_enabled(config: Column) -> Column:
    """The explicit flag, else whether any component or plugin is selected."""
    c = F.from_json(config, INDEX)
    chosen = F.coalesce(c.components.summary, F.lit(False)) | F.coalesce(c.components.images, F.lit(False)) | (F.coalesce(F.size(c.plugins), F.lit(0)) > 0)
    return F.coalesce(c.enabled, chosen, F.lit(False))


def disabled_docs(configs: DataFrame) -> DataFrame:
    """[doc_id] of documents out of the index, from effective index configs [id, config]."""
    return configs.filter(~index_enabled(F.col("config"))).select(F.col("id").alias("doc_id"))


STATE = "preset string, components string, organized_sha string, plugins map<string,string>"


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """[doc_id, name, change] (K3) from states [doc_id, preset, components, organized_sha, plugins]. FULL (name null) if there is
    no old state or its preset, text or components differ; else per plugin ADDED, REMOVED, CHANGED or UNCHANGED."""
    o = old.select("doc_id", *(F.col(c).alias(f"o_{c}") for c in ("preset", "components", "organized_sha", "plugins")), F.lit(True).alias("had"))
    both = new.join(o, "doc_id", "left")
    same = F.col("had") & F.col("preset").eqNullSafe(F.col("o_preset")) & F.col("components").eqNullSafe(F.col("o_components")) & F.col("organized_sha").eqNullSafe(F.col("o_organized_sha"))
    both = both.withColumn("same", F.coalesce(same, F.lit(False)))
    names = F.array_union(F.map_keys("plugins"), F.map_keys("o_plugins"))
    rows = both.filter("same").select("doc_id", "plugins", "o_plugins", F.explode(names).alias("name"))
    a, b = F.try_element_at("o_plugins", F.col("name")), F.try_element_at("plugins", F.col("name"))
    change = F.when(a.isNull(), "ADDED").when(b.isNull(), "REMOVED").when(a != b, "CHANGED").otherwise("UNCHANGED")
    return rows.select("doc_id", "name", change.alias("change")).unionByName(both.filter("not same").select("doc_id", F.lit(None).cast("string").alias("name"), F.lit("FULL").alias("change")))


def index_stale(configs: DataFrame, fps: DataFrame) -> DataFrame:
    """[doc_id, stale] (K3) from effective index configs [id, config] and [id, index_fp, fp]: in the index, and what was indexed is
    not what is there."""
    rows = configs.join(fps, "id", "left")
    return rows.select(F.col("id").alias("doc_id"), (index_enabled(F.col("config")) & ~F.col("index_fp").eqNullSafe(F.col("fp"))).alias("stale"))


def stage_decision(params: DataFrame, recorded: DataFrame) -> DataFrame:
    """[doc_id, stage, decision] (K4): skip if the artifact is there and the recorded parameters are equal and done."""
    r = recorded.select("doc_id", "stage", F.col("params").alias("old"), "done")
    rows = params.join(r, ["doc_id", "stage"], "left")
    ok = F.coalesce(F.col("present") & F.col("done") & (F.sha2("params", 256) == F.sha2("old", 256)), F.lit(False))
    return rows.select("doc_id", "stage", F.when(ok, "skip").otherwise("rerun").alias("decision"))


def remaining_items(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items [doc_id, num, ..] not covered (K5): a done number covers itself and what lies under it, never what is above;
    items without a number are never covered."""
    from folioforge.functions.text import ancestors

    keyed = items.withColumn("_id", F.struct(*items.columns))
    reach = keyed.filter("num is not null").select("doc_id", "_id", F.explode(F.array_append(ancestors(F.col("num")), F.col("num"))).alias("k"))
    covered = reach.join(done.select("doc_id", F.col("num").alias("k")).distinct(), ["doc_id", "k"]).select("_id").distinct()
    return keyed.join(covered, "_id", "left_anti").select(items.columns)


def check_moves(docs: DataFrame, kbs: DataFrame, moves: DataFrame, active: DataFrame) -> DataFrame:
    """[doc_id, kb_id, error] of a move or copy list: unknown kb, unknown document, running, or with an active job."""
    rows = moves.join(docs.select(F.col("id").alias("doc_id"), "status"), "doc_id", "left")
    rows = rows.join(kbs.select(F.col("id").alias("kb_id"), F.lit(True).alias("kb_ok")), "kb_id", "left").join(active.select("doc_id", F.lit(True).alias("busy")).distinct(), "doc_id", "left")
    error = F.when(F.col("kb_ok").isNull(), "unknown kb").when(F.col("status").isNull(), "unknown document").when(F.col("status").isin(*RUNNING), "running").when(F.col("busy"), "active job")
    return rows.select("doc_id", "kb_id", error.alias("error"))


def move_docs(docs: DataFrame, chunks: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks) after the moves without an error (K6)."""
    to = checked.filter("error is null").select(F.col("doc_id").alias("_d"), F.col("kb_id").alias("_k"))
    d = docs.join(to, docs["id"] == F.col("_d"), "left").withColumn("kb_id", F.coalesce("_k", "kb_id")).select(docs.columns)
    c = chunks.join(to, chunks["doc_id"] == F.col("_d"), "left").withColumn("kb_id", F.coalesce("_k", "kb_id")).select(chunks.columns)
    return d, c


def copy_docs(docs: DataFrame, chunks: DataFrame, checked: DataFrame, suffix: str = "（副本）") -> tuple[DataFrame, DataFrame]:
    """(new docs, new chunks) (K7): ids are hashes of source and target, vectors are reused."""
    to = checked.filter("error is null").select(F.col("doc_id").alias("_d"), F.col("kb_id").alias("_k"))
    new = lambda *c: F.sha2(F.concat_ws("|", *(F.col(x).cast("string") for x in c)), 256)
    d = docs.withColumn("id", F.col("id").cast("string")).join(to, F.col("id") == F.col("_d").cast("string")).withColumns({"id": new("id", "_k"), "name": F.concat("name", F.lit(suffix)), "kb_id": F.col("_k")}).select(docs.columns)
    c = chunks.join(to, chunks["doc_id"] == F.col("_d"))
    c = c.withColumns({"id": new("id", "_k"), "doc_id": new("doc_id", "_k"), "kb_id": F.col("_k")}).select(chunks.columns)
    return d, c


def delete_kbs(kbs: DataFrame, docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of the three tables without the kbs [id] (K8)."""
    kb = gone.select(F.col("id").alias("kb_id"))
    return kbs.join(gone.select("id"), "id", "left_anti"), docs.join(kb, "kb_id", "left_anti"), chunks.join(kb, "kb_id", "left_anti")


def delete_docs(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return docs.join(gone.select("id"), "id", "left_anti"), chunks.join(gone.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def place_first(docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """[kb_id, sort_order] for a new document of each kb: 1000 before the first, 1000 in an empty kb (K9)."""
    least = docs.groupBy("kb_id").agg(F.min("sort_order").alias("m"))
    return kbs.select(F.col("id").alias("kb_id")).join(least, "kb_id", "left").select("kb_id", F.coalesce(F.col("m") - 1000.0, F.lit(1000.0)).alias("sort_order"))


def reorder(docs: DataFrame, orders: DataFrame) -> DataFrame:
    """Docs with the given order [kb_id, id, pos], pos from 1: 1000, 2000, ..; documents not named keep theirs."""
    new = orders.select("kb_id", "id", (1000.0 * F.col("pos")).alias("_o"))
    return docs.join(new, ["kb_id", "id"], "left").withColumn("sort_order", F.coalesce("_o", "sort_order")).select(docs.columns)


def backfill_order(docs: DataFrame) -> DataFrame:
    """Docs with sort_order from status group, then newest first within a status, then id (K9). Places within a status are counted over
    ranges, and the documents of the groups before are a sum over the few counts of a kb, so a kb may be of any size."""
    group = F.when(F.col("status").isin("parsing", "generating"), 0).when(F.col("status") == "pending", 1).when(F.col("status") == "ready", 2).when(F.col("status") == "done", 3).otherwise(4)
    rows = docs.withColumn("_g", group).withColumn("_ks", F.struct("kb_id", "status"))
    counts = rows.groupBy(F.col("kb_id").alias("_kb"), F.col("_g").alias("_gr")).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_kb").orderBy("_gr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("_kb", "_gr", before.alias("_before"))
    placed = number_within(rows, "_own", "_ks", F.desc("created_at"), "id")
    placed = placed.join(broadcast_if_small(before), F.col("kb_id").eqNullSafe(F.col("_kb")) & (F.col("_g") == F.col("_gr")))
    return placed.withColumn("sort_order", 1000.0 * (F.col("_before") + F.col("_own"))).select(docs.columns)


def backfill_kbs(kbs: DataFrame) -> DataFrame:
    """Kbs with sort_order 1000, 2000, .. by created_at, then id; numbered over ranges."""
    cols = [c for c in kbs.columns if c != "sort_order"]
    return number_rows(kbs.select(cols), "_n", "created_at", "id").withColumn("sort_order", 1000.0 * F.col("_n")).select(*cols, "sort_order")


def list_docs(docs: DataFrame, kb_id) -> DataFrame:
    """One kb's documents with their place in its listing, from 1."""
    return number_rows(docs.filter(F.col("kb_id") == kb_id), "place", "sort_order", F.desc("created_at"), "id")


def recover_status(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Docs after a restart (K11): generating and queued are ready; parsing and fetching are ready if the manifest
    [doc_id] has their text, else failed."""
    has = manifest.select(F.col("doc_id").alias("id"), F.lit(True).alias("_has")).distinct()
    status = F.when(F.col("status").isin("generating", "queued"), "ready").when(F.col("status").isin("parsing", "fetching"), F.when(F.col("_has"), "ready").otherwise("failed")).otherwise(F.col("status"))
    return docs.join(has, "id", "left").withColumn("status", status).select(docs.columns)


def active_docs(jobs: DataFrame) -> DataFrame:
    """[doc_id] named by active jobs [doc_id, payload, active]."""
    on = jobs.filter("active")
    listed = on.select(F.explode(F.from_json("payload", "docIds array<string>")["docIds"]).alias("doc_id"))
    return on.select(F.col("doc_id").cast("string").alias("doc_id")).filter("doc_id is not null and doc_id <> ''").union(listed).distinct()


def _brief(own: Column | None = None) -> Column:
    title = F.when((F.coalesce("title", F.lit("")) != "") & (F.col("title") != F.col("name")), F.concat(F.lit("（"), "title", F.lit("）"))).otherwise("")
    digest = F.when(F.coalesce("digest", F.lit("")) != "", F.concat(F.lit("："), "digest")).otherwise("")
    end = F.lit("") if own is None else F.when(own, "（本文档）").otherwise("")
    return F.concat(F.lit("- 《"), "name", F.lit("》"), title, digest, F.lit(" ｜ doc_id="), F.col("id").cast("string"), end)


def kb_overview(docs: DataFrame, current: DataFrame) -> DataFrame:
    """[doc_id, overview] for current documents [doc_id] (K13), from docs [id, kb_id, name, title, digest, enabled, preset_id,
    organized, created_at]: a line for every other document of the kb that is not explicitly disabled and has a preset
    and a text, oldest first, the current one last.

    An overview holds its kb's lines, so the result grows with documents asked times lines. The lines are joined once, in blocks of
    ``OVERVIEW_LINES``; a current document puts its own block together anew and takes the others as they are. Current documents are
    dealt out by the bytes they will write. ``kb_lines`` gives the same without copies.
    """
    lines = materialize(kb_lines(docs.filter("kb_id is not null")).withColumn("block", ((F.col("place") - 1) / OVERVIEW_LINES).cast("int")))
    text = lambda order, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), F.col(x).alias("x")))), lambda r: r.x), "\n")
    shown = lines.filter("place is not null")
    blocks = shown.groupBy("kb_id", "block").agg(text("place", "line").alias("text"))
    kept = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda r: r.text)
    kbs = materialize(blocks.groupBy("kb_id").agg(kept.alias("texts"), F.sum(F.octet_length("text")).alias("bytes")))
    asked = materialize(current.select("doc_id").distinct().join(lines.drop("line"), "doc_id"))
    others = shown.select("kb_id", "block", F.col("place").alias("p"), "line")
    own = asked.join(others, ["kb_id", "block"]).filter("p <> place").groupBy("doc_id").agg(text("p", "line").alias("rest"))
    rows = asked.join(own, "doc_id", "left")
    size = asked.groupBy("kb_id").count().join(kbs, "kb_id").agg(F.sum(F.col("count") * F.col("bytes"))).first()[0] or 0
    parts = max(-(-size // OVERVIEW_BYTES), asked.sparkSession.sparkContext.defaultParallelism)
    if (kbs.agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_BYTES:
        rows = rows.repartition(parts, "doc_id").join(F.broadcast(kbs), "kb_id", "left")
    else:  # copies of a kb's blocks meet shares of its documents
        share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int")
        copies = kbs.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        rows = rows.withColumn("share", share).repartition(parts, "kb_id", "share").join(copies.hint("shuffle_hash"), ["kb_id", "share"], "left")
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    before, after = F.slice("texts", F.lit(1), F.col("block")), F.slice("texts", F.col("block") + 2, F.size("texts"))
    pieces = F.when(F.col("block").isNull(), texts).otherwise(F.concat(before, F.array("rest"), after))
    return rows.select("doc_id", F.array_join(F.array_append(pieces, F.col("own_line")), "\n").alias("overview"))


def kb_lines(docs: DataFrame) -> DataFrame:
    """[kb_id, doc_id, place, line, own_line] for every document (K13): its line in the overviews of the others and the place
    of that, null where it is not shown, and its line in its own. An overview is the kb's lines by place without the current
    document's, then the current one's own; nothing is copied per document."""
    shown = F.coalesce("enabled", F.lit(True)) & F.col("preset_id").isNotNull() & F.coalesce("organized", F.lit(False))
    rows = docs.select("kb_id", F.col("id").alias("doc_id"), "created_at", shown.alias("shown"), _brief(F.lit(False)).alias("line"), _brief(F.lit(True)).alias("own_line"))
    rows = number_within(rows, "n", "kb_id", F.desc("shown"), "created_at", "doc_id")
    return rows.select("kb_id", "doc_id", F.when(F.col("shown"), F.col("n")).alias("place"), "line", "own_line")


def lookup_toc(tocs: DataFrame, allowed: DataFrame, most: int = 8000) -> DataFrame:
    """[doc_id, toc] of allowed documents, cut."""
    return tocs.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.left("toc", F.lit(most)).alias("toc"))


def lookup_summary(blocks: DataFrame, headings: DataFrame, allowed: DataFrame, most: int = 12000) -> DataFrame:
    """[doc_id, summary]: ``### title`` and text of each summary block of allowed documents, cut."""
    rows = blocks.filter("type = 'summary' and content <> ''").join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.join(headings.select("doc_id", F.col("num").alias("target"), "title"), ["doc_id", "target"], "left")
    label = F.coalesce("title", F.nullif("target", F.lit("")), F.lit("（未编号节）"))
    x = F.struct("ord", F.concat(F.lit("### "), label, F.lit("\n"), F.trim("content")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(x)), lambda r: r.x), "\n\n")
    return rows.groupBy("doc_id").agg(F.left(text, F.lit(most)).alias("summary"))


def dedupe_normalized(df: DataFrame, text: Column, kind: str, order: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each kind and normalised text (K15), not minding the meta lines with a key of ``ignore``. Copies meet
    in one aggregate, combined before the exchange; the winners come back by a semi-join. Of rows equal in kind, text and
    order one stays. Hashes are taken once and kept beside kind and order; only where rows share both are they taken again, to
    tell those rows apart."""
    own = F.sha2(norm_ws(cut_meta_keys(text, ignore) if ignore else text), 256)
    hashes = materialize(df.select(kind, order, own.alias("_h")))
    first = hashes.groupBy(kind, "_h").agg(F.min(order).alias(order))
    if hashes.groupBy(kind, order).count().filter("count > 1").isEmpty():
        return df.join(first.select(kind, order), [kind, order], "left_semi")
    return df.withColumn("_h", own).join(first, [kind, "_h", order], "left_semi").dropDuplicates([kind, "_h", order]).drop("_h")


def number_rows(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with the place of each row, from 1, in ``order``, which leaves no ties: places within ranges, plus the rows of
    the ranges before; only one count a range meets in one task."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).select("_p", before.alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_k", own).join(F.broadcast(offsets), "_p").select(*df.columns, (F.col("_k") + F.col("_b")).cast("int").alias(name))


def number_within(df: DataFrame, name: str, key: str, *order: str | Column) -> DataFrame:
    """``df`` with the place of each row, from 1, within its ``key``; a large key lies in many ranges."""
    rows = number_rows(df, "_n", key, *order)
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_n").alias("_f"))
    return rows.join(broadcast_if_small(first), F.col(key).eqNullSafe(F.col("_key"))).select(*df.columns, (F.col("_n") - F.col("_f") + 1).alias(name))


def _component_keys(df: DataFrame) -> DataFrame:
    key = F.when(F.coalesce("where_id", F.lit("")) != "", F.concat(F.lit("id:"), "where_id")).otherwise(F.concat(F.lit("own:"), norm_ws(F.coalesce("where_text", F.lit("")))))
    return df.select(key.alias("key"), "ord", "name")


def component_rows(df: DataFrame) -> DataFrame:
    """[grp, key, ord, name] of [ord, name, where_id, where_text] (K16), a row for each member, so a group may be of any size."""
    rows = _component_keys(df)
    first = number_rows(rows.groupBy("key").agg(F.min("ord").alias("first")), "grp", "first")
    return rows.join(broadcast_if_small(first.select("grp", "key")), "key").select("grp", "key", "ord", "name")


def group_components(df: DataFrame) -> DataFrame:
    """[grp, key, members] of [ord, name, where_id, where_text] (K16): by id if set, else by normalised text; groups and
    members in order of first appearance. A group is one row here; ``component_rows`` gives its members as rows."""
    rows = _component_keys(df).groupBy("key").agg(F.min("ord").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("members"))
    return number_rows(rows, "grp", "first").select("grp", "key", "members")


def quality_report(blocks: DataFrame, leaves: DataFrame, residue: DataFrame, summaries: DataFrame, h2: DataFrame, names: list[str]) -> DataFrame:
    """[doc_id, warnings] (K17). ``leaves`` [doc_id, n_leaf], ``residue`` [doc_id, stray_chars], ``summaries`` [doc_id, found, kept],
    ``h2`` [doc_id, n_h2, n_pages]."""
    counts = blocks.groupBy("doc_id").agg(*(F.count(F.when(F.col("type") == n, 1)).alias(f"n_{n}") for n in names))
    rows = leaves.join(counts, "doc_id", "left").join(residue, "doc_id", "left").join(summaries, "doc_id", "left").join(h2, "doc_id", "left")
    warn = [
        F.when(F.col("stray_chars") > 50, F.concat(F.lit("stray characters: "), F.col("stray_chars").cast("string"))),
        *(F.when(F.coalesce(f"n_{n}", F.lit(0)) != F.col("n_leaf"), F.concat(F.lit(f"{n}: "), F.coalesce(f"n_{n}", F.lit(0)).cast("string"), F.lit(" blocks, "), F.col("n_leaf").cast("string"), F.lit(" leaf sections"))) for n in names),
        F.when(F.col("kept") < F.col("found"), F.concat(F.lit("summaries lost: "), (F.col("found") - F.col("kept")).cast("string"))),
        F.when((F.col("n_h2") == 1) & (F.col("n_pages") > 10), F.lit("single second-level heading")),
    ]
    return rows.select("doc_id", F.array_compact(F.array(*warn)).alias("warnings"))


def artifacts_fp(manifest: DataFrame) -> DataFrame:
    """[doc_id, fp] of [doc_id, name, size, mtime]; documents without their main text have none."""
    row = F.struct("name", F.concat(F.col("name"), F.lit("\n"), F.col("size").cast("string"), F.lit(":"), F.col("mtime").cast("string"), F.lit("\n")).alias("x"))
    agg = manifest.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("a"), F.max(F.col("name") == "organized.md").alias("ok"))
    return agg.filter("ok").select("doc_id", F.sha2(F.array_join(F.transform("a", lambda r: r.x), ""), 256).alias("fp"))


def stale_snapshots(fps: DataFrame, configs: DataFrame, snapshots: DataFrame, version: int) -> DataFrame:
    """[doc_id] to rebuild (K18): artifact fingerprint, config hash, version or export do not match."""
    rows = fps.join(configs.select("doc_id", F.sha2("config", 256).alias("cfg")), "doc_id").join(snapshots, "doc_id", "left")
    fresh = (F.col("gen_fp") == F.col("fp")) & (F.col("cfg_hash") == F.col("cfg")) & (F.col("anchor_gen") == version) & F.col("has_export")
    return rows.filter(~F.coalesce(fresh, F.lit(False))).select("doc_id")


def evict_exports(df: DataFrame, keep: int = 3) -> DataFrame:
    """Cached exports [doc_id, name, mtime] beyond the newest ``keep`` of a document (K19). Names are unique to a document; a null
    time is the oldest. Every task keeps that many of a document before the exchange, and only the last one that stays is joined
    back."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("mtime"), "name")
    last = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).filter(F.col("_n") == keep)
    last = last.select(F.col("doc_id").alias("_d"), F.col("mtime").alias("_t"), F.col("name").alias("_l"))
    rows = df.join(broadcast_if_small(last), F.col("doc_id").eqNullSafe(F.col("_d")))
    older = F.coalesce(F.col("mtime") < F.col("_t"), F.col("mtime").isNull() & F.col("_t").isNotNull())
    return rows.filter(older | (F.col("mtime").eqNullSafe(F.col("_t")) & (F.col("name") > F.col("_l")))).select(df.columns)
