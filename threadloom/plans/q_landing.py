"""Queries over recorders, memos, exports, ledgers and links, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.operators import identity as I
from threadloom.operators import records as R
from threadloom.plans import tables as t
from threadloom.plans.tables import sql
from threadloom.sources import mappers as M
from threadloom.storage import materialize

QUERIES, SQL = {}, {}
#: Rows of the landing folder that one bundle of threads holds, on average.
FILE_ROWS = 250_000


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


@query("map_recorder_items", sql("thread_records", "SELECT 'plaud:' || conv_id AS id, count(DISTINCT role) AS people FROM thread_records GROUP BY conv_id"))
def map_recorder_items(spark, sf):
    r = t.thread_records(spark, sf).groupBy("conv_id").agg(F.collect_set("role").alias("people"), F.min("ts").alias("at"))
    out = M.records_of(r, id=F.concat(F.lit("plaud:"), F.col("conv_id").cast("string")), source=F.lit("plaud"), kind=F.lit("recording"), ts=F.col("at"), recipients=F.transform("people", lambda p: M.party(H.name_handle(p), p)))
    return out.select("id", F.size("recipients").cast("bigint").alias("people"))


@query("map_voice_memos", sql("thread_records", "SELECT 'memos:' || conv_id AS id, conv_id % 3 <> 0 AS needs_transcript FROM thread_records GROUP BY conv_id"))
def map_voice_memos(spark, sf):
    """A transcript of an earlier run is carried over; without one the memo waits for it."""
    memos = t.thread_records(spark, sf).groupBy("conv_id").agg(F.min("ts").alias("at"))
    prior = t.thread_records(spark, sf).where("conv_id % 3 = 0").groupBy("conv_id").agg(F.min("text").alias("prior"))
    both = memos.join(prior, "conv_id", "left").withColumn("t", F.coalesce("prior", F.lit("")))
    return both.select(F.concat(F.lit("memos:"), F.col("conv_id").cast("string")).alias("id"), (F.col("t") == "").alias("needs_transcript"))


@query("map_call_recordings", sql("records", "SELECT m.id, c.other FROM (SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records WHERE kind = 'meeting') m JOIN (SELECT a.id AS i, arg_min(b.other, (abs(a.s - b.s), b.id)) AS other FROM (SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records WHERE kind = 'meeting') a JOIN (SELECT id, other, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records WHERE kind = 'call') b ON abs(a.s - b.s) <= 180 GROUP BY a.id) c ON c.i = m.id"))
def map_call_recordings(spark, sf):
    r = t.records(spark, sf).withColumn("at", F.unix_seconds("ts"))
    calls = r.where("kind = 'call'")
    near = R.nearest_within(r.where("kind = 'meeting'").select("id", "at"), calls.select(F.col("id").alias("rid"), F.col("at").alias("rat")))
    return near.join(calls.select(F.col("id").alias("rid"), "other"), "rid").select("id", "other")


@query("map_im_messages", sql("thread_records contacts", "SELECT m.id, coalesce(c.name, m.sender) AS name FROM thread_records m LEFT JOIN contacts c ON c.card = m.conv_id % 200 WHERE m.role <> 'system'"))
def map_im_messages(spark, sf):
    names = t.contacts(spark, sf).select((F.col("card")).alias("k"), "name")
    m = t.thread_records(spark, sf).where("role <> 'system'").withColumn("k", F.col("conv_id") % 200)
    return m.join(names, "k", "left").select("id", F.coalesce("name", "sender").alias("name"))


@query("source_registry", sql("records", "SELECT label, count(r.id) AS n FROM (SELECT unnest(['message', 'email', 'call']) AS kind, unnest(['Chat', 'Mail', 'Calls']) AS label) k JOIN records r USING (kind) GROUP BY label"))
def source_registry(spark, sf):
    known = spark.createDataFrame([("message", "Chat"), ("email", "Mail"), ("call", "Calls")], "kind string, label string")
    return t.records(spark, sf).join(F.broadcast(known), "kind").groupBy("label").agg(F.count("*").alias("n"))


@query("chat_name_thread_join", sql("projects", "SELECT title AS name, min(id) AS thread FROM projects GROUP BY title"))
def chat_name_thread_join(spark, sf):
    p = t.projects(spark, sf).withColumn("priority", F.lit(1))
    best = Window.partitionBy(T.name_norm(F.col("title"))).orderBy("priority", "id")
    return p.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("title").alias("name"), F.col("id").alias("thread"))


@query("prior_id_overlap_join", sql("contacts", "SELECT 'c' || card AS root, 'p' || card AS person_id FROM contacts"))
def prior_id_overlap_join(spark, sf):
    c = t.contacts(spark, sf).select(F.concat(F.lit("c"), F.col("card").cast("string")).alias("root"), F.concat(F.lit("p"), F.col("card").cast("string")).alias("person_id"), F.explode(F.array("phone", "mail")).alias("handle"))
    return I.stable_ids(c.select("root", "handle"), c.select("person_id", "handle"))


@query("note_attachment_join", sql("items projects", "SELECT i.target, i.seq, i.part, min(p.id) AS audio FROM items i JOIN projects p ON p.id = i.part GROUP BY ALL"))
def note_attachment_join(spark, sf):
    i = t.items(spark, sf).select("target", "seq", "part").distinct()
    return i.join(t.projects(spark, sf).select(F.col("id").alias("part"), F.col("id").alias("audio")), "part").select("target", "seq", "part", "audio")


@query("write_batches", sql("commitments", "SELECT id FROM commitments"))
def write_batches(spark, sf):
    """Ids in the ledger are skipped, new ones are appended; writing twice adds nothing."""
    c = t.commitments(spark, sf).select("id")
    ledger = c.where("id % 3 = 0")
    fresh = c.join(ledger, "id", "left_anti")
    after = materialize(ledger.unionByName(fresh), "ledger")
    return after.unionByName(c.join(after, "id", "left_anti"))


@query("write_dossiers", sql("records", "SELECT kind, count(*) AS n FROM records GROUP BY kind"))
def write_dossiers(spark, sf):
    doc = t.records(spark, sf).select("kind", F.to_json(F.struct("id", "thread", "other")).alias("doc"))
    return materialize(doc, "dossiers").groupBy("kind").agg(F.count(F.get_json_object("doc", "$.id")).alias("n"))


@query("repair_links", sql("items projects", "SELECT i.target, i.seq, i.part, '[[' || p.title || ']]' AS link FROM items i JOIN projects p ON p.id = i.part"))
def repair_links(spark, sf):
    """A link to an old name is replaced by the present title."""
    links = t.items(spark, sf).select("target", "seq", "part", F.concat(F.lit("[["), "ref", F.lit("]]")).alias("text"))
    names = t.projects(spark, sf).select(F.concat(F.lit("part:"), F.col("id").cast("string")).alias("old"), "title")
    found = links.withColumn("old", F.regexp_extract("text", r"\[\[([^\]]+)\]\]", 1)).join(names, "old")
    return found.select("target", "seq", "part", F.replace("text", F.col("old"), F.col("title")).alias("link"))


@query("apply_resolved", sql("commitments", "SELECT id, CASE WHEN id % 4 = 0 AND status = 'open' THEN 'done' ELSE status END AS status FROM commitments"))
def apply_resolved(spark, sf):
    c = t.commitments(spark, sf).select("id", "status")
    confirmed = c.where("id % 4 = 0").select("id", F.lit(True).alias("confirmed"))
    closes = F.coalesce("confirmed", F.lit(False)) & (F.col("status") == "open")
    return c.join(confirmed, "id", "left").select("id", F.when(closes, "done").otherwise(F.col("status")).alias("status"))


@query("merge_all", sql("items", "SELECT target, arg_max(supplier, (date, seq, supplier)) AS supplier, count(*) AS facts FROM items GROUP BY target"))
def merge_all(spark, sf):
    """All facts at once; the order of batches is in the sequence, so windows agree with merging one by one."""
    i = t.items(spark, sf).withColumn("s", F.struct("seq", "supplier"))
    latest = R.latest_fact_wins(i.select("target", "supplier", "date", F.col("s").alias("seq")), "target", ["supplier"])
    return latest.join(i.groupBy("target").agg(F.count("*").alias("facts")), "target")


@query("merge_order", sql("commitments items", "SELECT target, count(*) AS linked FROM items WHERE target IN (SELECT id FROM commitments) GROUP BY target"))
def merge_order(spark, sf):
    """Entities first, then what links to them."""
    made = t.commitments(spark, sf).select(F.col("id").alias("target")).distinct()
    return t.items(spark, sf).join(made, "target", "left_semi").groupBy("target").agg(F.count("*").alias("linked"))


@query("map_strings", sql("projects", "SELECT id, upper(title) AS title, upper(company) AS company FROM projects"))
def map_strings(spark, sf):
    """One function over every string column, keys left alone."""
    p = t.projects(spark, sf).select("id", "title", "company")
    return p.select(*(F.upper(c).alias(c) if kind == "string" else F.col(c) for c, kind in p.dtypes))


@query("file_signature_skip", sql("records", "SELECT thread, count(*) AS n, sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS changed FROM records WHERE user_id % 3 < 2 GROUP BY thread"))
def file_signature_skip(spark, sf):
    """Three runs over a folder of files that hold many threads each: a third is there from the start, a third comes later and a third of the first changes. Runs two and three take what is new; this is what they took."""
    from threadloom.sources import files
    from threadloom.streaming.ingest import new_folder

    r = t.records(spark, sf).select("id", "thread", "user_id")
    folder, state, out = new_folder(spark, "landed"), new_folder(spark, "signatures"), new_folder(spark, "taken")
    bundles = max(8, -(-r.count() // FILE_ROWS))  # one number; files follow the rows, not the threads
    r = r.withColumn("third", F.col("user_id") % 3).withColumn("bundle", F.pmod(F.xxhash64("thread"), F.lit(bundles)))
    put = lambda df, kind: df.repartition("third", "bundle").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("third", "bundle").parquet(f"{folder}/{kind}")

    def take(paths):
        spark.read.option("basePath", folder).parquet(*paths).write.mode("append").parquet(out)

    put(r.where("third in (0, 2)"), "old")
    files.ingest_changed(spark, folder, state, lambda paths: None, "*.parquet")
    put(r.where("third < 2 and third <> 0"), "new")
    files.ingest_changed(spark, folder, state, take, "*.parquet")
    put(r.where("third = 0").withColumn("user_id", F.col("user_id") + 0), "old")  # written anew
    files.ingest_changed(spark, folder, state, take, "*.parquet")
    assert files.ingest_changed(spark, folder, state, take, "*.parquet") == 0
    return spark.read.parquet(out).groupBy("thread").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") % 3 == 0).alias("changed"))


@query("role_vocabulary", sql("projects", "SELECT type, CASE type WHEN 'ECONOMY' THEN 'low' ELSE 'other' END AS label, count(*) AS n FROM projects GROUP BY ALL"))
def role_vocabulary(spark, sf):
    words = spark.createDataFrame([("ECONOMY", "low")], "type string, label string")
    return t.projects(spark, sf).join(F.broadcast(words), "type", "left").groupBy("type", F.coalesce("label", F.lit("other")).alias("label")).agg(F.count("*").alias("n"))


@query("aggregate_functions", sql("items", "SELECT supplier, mode_part, n FROM (SELECT supplier, part AS mode_part, count(*) AS n, row_number() OVER (PARTITION BY supplier ORDER BY count(*) DESC, part) AS r FROM items GROUP BY supplier, part) WHERE r = 1"))
def aggregate_functions(spark, sf):
    n = t.items(spark, sf).groupBy("supplier", "part").agg(F.count("*").alias("n"))
    return n.groupBy("supplier").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).select("supplier", (-F.col("m.p")).alias("mode_part"), F.col("m.n").alias("n"))


@query("identity_scan", sql("contacts", "SELECT company, count(*) AS people FROM contacts GROUP BY company"))
def identity_scan(spark, sf):
    return t.contacts(spark, sf).groupBy("company").agg(F.count("*").alias("people"))


@query("queue_scan", sql("commitments", "SELECT id, direction FROM commitments WHERE status = 'open' AND direction = 'delegated'"))
def queue_scan(spark, sf):
    return t.commitments(spark, sf).where("status = 'open' and direction = 'delegated'").select("id", "direction")


@query("table_functions", sql("thread_records", "SELECT id, length(string_split(text, chr(10))) AS lines FROM thread_records"))
def table_functions(spark, sf):
    return t.thread_records(spark, sf).select("id", F.explode(F.split("text", "\n")).alias("l")).groupBy("id").agg(F.count("*").alias("lines"))


@query("source_plugin", sql("records thread_records", "SELECT 'events' AS plugin, count(*) AS n FROM records UNION ALL SELECT 'chats', count(*) FROM thread_records"))
def source_plugin(spark, sf):
    from threadloom.sources.plugins import Source, extract_all

    found = extract_all(spark, [Source("events", lambda s: None, lambda s: t.records(s, sf)), Source("chats", lambda s: None, lambda s: t.thread_records(s, sf)), Source("none", lambda s: "no_data", lambda s: t.records(s, sf))])
    return found.groupBy("plugin").agg(F.count("*").alias("n"))


@query("scrub_override", "SELECT doc_id, regexp_replace(text, '[0-9]', '#', 'g') AS scrubbed FROM documents")
def scrub_override(spark, sf):
    from threadloom.sources.plugins import scrub_with

    return scrub_with(t.read(spark, sf, "documents").select("doc_id", "text"), lambda c: F.regexp_replace(c, "[0-9]", "#")).select("doc_id", "scrubbed")


@query("transcriber_hook", sql("thread_records", "SELECT id AS path, CASE WHEN turn % 2 = 0 THEN 'Ann: ' || length(encode(text)) ELSE '' END AS text, turn % 2 = 1 AS needs_transcript FROM thread_records".replace("length(encode(text))", "octet_length(encode(text))")))
def transcriber_hook(spark, sf):
    from threadloom.sources.plugins import transcribe

    files = t.thread_records(spark, sf).select(F.concat("id", F.when(F.col("turn") % 2 == 1, "!").otherwise("")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    heard = transcribe(files, lambda content, path: None if path.endswith("!") else [("Ann", str(len(content)))])
    return heard.withColumn("path", F.regexp_replace("path", "!$", ""))


@query("cleanup_apply", sql("projects items commitments", "SELECT 'folded' AS step, count(*) AS n FROM (SELECT id, first_value(id) OVER (PARTITION BY title, company ORDER BY size DESC, id) AS keep FROM projects) WHERE id <> keep UNION ALL SELECT 'closed', count(*) FROM commitments WHERE status = 'open' AND id % 4 = 0 UNION ALL SELECT 'bullets', count(*) FROM items WHERE part IN (SELECT id FROM projects)"))
def cleanup_apply(spark, sf):
    """Duplicates are folded and their bullets moved, confirmed commitments are closed; each step's rows are counted."""
    order = Window.partitionBy("title", "company").orderBy(F.desc("size"), "id")
    mapping = t.projects(spark, sf).select(F.col("id").alias("part"), F.first("id").over(order).alias("keep"))
    moved = t.items(spark, sf).join(mapping, "part").withColumn("part", F.col("keep"))
    before = t.commitments(spark, sf).select("id", F.col("status").alias("old"))
    closed = apply_resolved(spark, sf).join(before, "id").where("status <> old")
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
    return part(mapping.where("part <> keep"), "folded").unionByName(part(closed, "closed")).unionByName(part(moved, "bullets"))
