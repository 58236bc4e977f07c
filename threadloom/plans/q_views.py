"""Queries over windows, views, set operations, merging and increments, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import records as R
from threadloom.operators.context import known_context as known_context_of
from threadloom.plans import tables as t
from threadloom.plans.q_scalar import norm
from threadloom.plans.tables import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def today():
    return F.lit(t.ORDERS_NOW).cast("date")


_TODAY = "DATE '2001-08-02'"


@query("records_scan", sql("records", "SELECT id, epoch_us(ts) AS ts_us FROM records WHERE kind = 'email' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, id LIMIT 500"))
def records_scan(spark, sf):
    since, until = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return R.records_scan(t.records(spark, sf), kind="email", since=since, until=until, limit=500).select("id", F.unix_micros("ts").alias("ts_us"))


@query("record_lookup", sql("records", "SELECT id, kind, thread FROM records WHERE id = 'events:17'"))
def record_lookup(spark, sf):
    return t.records(spark, sf).where("id = 'events:17'").select("id", "kind", "thread")


@query("upsert_records", sql("records", "SELECT CASE WHEN k % 4 = 0 THEN 'inserted' WHEN k % 4 = 1 THEN 'updated' WHEN k % 4 = 2 THEN 'unchanged' ELSE 'kept' END AS action, count(*) AS n FROM (SELECT CAST(substr(id, 8) AS BIGINT) AS k FROM records) GROUP BY ALL"))
def upsert_records(spark, sf):
    r = t.records(spark, sf).withColumn("k", F.substr("id", F.lit(8)).cast("bigint") % 4)
    at = F.lit("2024-01-31").cast("timestamp")
    old = r.where("k <> 0").select("id", "kind", "duration_s", at.alias("ingested_at"), at.alias("changed_at"))
    new = r.where("k <> 3").select("id", "kind", (F.col("duration_s") + F.when(F.col("k") == 1, 1).otherwise(0)).alias("duration_s"), F.lit(1).alias("seq"))
    return R.upsert_records(old, new, F.lit(t.NOW).cast("timestamp"), ["kind", "duration_s"]).groupBy("action").agg(F.count("*").alias("n"))


@query("ingest_totals", sql("records", "SELECT kind, count(*) AS read, count(*) FILTER (duration_s > 30) AS kept, count(*) FILTER (duration_s <= 30) AS excluded FROM records GROUP BY kind"))
def ingest_totals(spark, sf):
    return t.records(spark, sf).groupBy("kind").agg(F.count("*").alias("read"), F.count_if(F.expr("duration_s > 30")).alias("kept"), F.count_if(F.expr("duration_s <= 30")).alias("excluded"))


@query("save_cursor", sql("records", "SELECT kind AS source, arg_max(id, (ts, id)) AS cursor FROM records GROUP BY kind"))
def save_cursor(spark, sf):
    return R.last_write(t.records(spark, sf).select("kind", "id", "ts"), "kind", "id", "ts").select(F.col("kind").alias("source"), F.col("id").alias("cursor"))


@query("newest_within_budget", sql("notes", "SELECT id, source FROM (SELECT id, source, sum(n_chars) OVER w AS spent, row_number() OVER w AS r FROM notes WINDOW w AS (PARTITION BY source ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING)) WHERE spent <= 32000 OR r = 1"))
def newest_within_budget(spark, sf):
    return R.newest_within_budget(t.notes(spark, sf), "source", F.col("n_chars"), 32_000).select("id", "source")


@query("shrink_oversized", sql("notes", "SELECT source, count(*) FILTER (spent <= 8000 OR r = 1) AS kept, count(*) - count(*) FILTER (spent <= 8000 OR r = 1) AS omitted FROM (SELECT source, sum(n_chars) OVER w AS spent, row_number() OVER w AS r FROM notes WINDOW w AS (PARTITION BY source ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING)) GROUP BY source"))
def shrink_oversized(spark, sf):
    kept = R.newest_within_budget(t.notes(spark, sf), "source", F.col("n_chars"), 8_000)
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.max("omitted").alias("omitted"))


@query("merge_speaker_turns", sql("thread_records", "SELECT conv_id, role AS speaker, min(turn) AS start, count(*) AS lines FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM thread_records) GROUP BY conv_id, role, g"))
def merge_speaker_turns(spark, sf):
    turns = t.thread_records(spark, sf).select("conv_id", "turn", F.col("role").alias("speaker"), "text")
    return R.merge_speaker_turns(turns, "conv_id", "turn").select("conv_id", "speaker", "start", "lines")


@query("ack_after_request")
def ack_after_request(spark, sf):
    return R.ack_after_request(t.thread_records(spark, sf), "thread").select("id", "thread")


_PACKED = """numbered AS (SELECT source, doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM notes),
walk AS (SELECT source, doc_id, tokens, r, 1 AS batch, coalesce(tokens, 0) AS spent, 1 AS n FROM numbered WHERE r = 1 UNION ALL
  SELECT x.source, x.doc_id, x.tokens, x.r, w.batch + CASE WHEN w.spent + coalesce(x.tokens, 0) > 34000 OR w.n >= 25 THEN 1 ELSE 0 END,
    CASE WHEN w.spent + coalesce(x.tokens, 0) > 34000 OR w.n >= 25 THEN 0 ELSE w.spent END + coalesce(x.tokens, 0), CASE WHEN w.spent + coalesce(x.tokens, 0) > 34000 OR w.n >= 25 THEN 1 ELSE w.n + 1 END
  FROM walk w JOIN numbered x ON x.source IS NOT DISTINCT FROM w.source AND x.r = w.r + 1)"""


@query("pack_batches", sql("notes", "SELECT source, doc_id, tokens, batch FROM walk", _PACKED).replace("WITH", "WITH RECURSIVE", 1))
def pack_batches(spark, sf):
    items = t.notes(spark, sf).select("source", "doc_id", T.estimate_tokens(F.col("text")).cast("bigint").alias("tokens"))
    return R.pack_batches(items, "source", ["doc_id"], "tokens", 34_000, 25)


_CHUNKED = """lines AS (SELECT conv_id, turn, length(text) + 1 AS length, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM thread_records),
numbered AS (SELECT conv_id, turn, length, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM lines WHERE total <= 90000),
walk AS (SELECT *, 1 AS chunk, length AS spent FROM numbered WHERE r = 1 UNION ALL
  SELECT x.*, w.chunk + CASE WHEN w.spent + x.length > 2000 THEN 1 ELSE 0 END, CASE WHEN w.spent + x.length > 2000 THEN 0 ELSE w.spent END + x.length FROM walk w JOIN numbered x ON x.conv_id = w.conv_id AND x.r = w.r + 1)"""


@query("chunk_transcript", sql("thread_records", "SELECT conv_id, turn, length, chunk FROM walk", _CHUNKED).replace("WITH", "WITH RECURSIVE", 1))
def chunk_transcript(spark, sf):
    return R.chunk_lines(t.thread_records(spark, sf).select("conv_id", "turn", "text"), "conv_id", "turn", 2_000, 90_000)


@query("duplicate_ordinal", sql("records", "SELECT id, row_number() OVER (PARTITION BY thread, kind, duration_s ORDER BY id) AS n FROM records"))
def duplicate_ordinal(spark, sf):
    return R.duplicate_ordinal(t.records(spark, sf), ["thread", "kind", "duration_s"], "id").select("id", F.col("n").cast("bigint").alias("n"))


@query("assign_sequence", sql("items", "SELECT target, seq0, row_number() OVER (ORDER BY part, target, seq0) AS seq FROM (SELECT target, part, seq AS seq0 FROM items)"))
def assign_sequence(spark, sf):
    rows = t.items(spark, sf).select("part", "target", F.col("seq").alias("seq0")).withColumn("o", F.struct("target", "seq0"))
    return R.assign_sequence(rows, "part", "o").select("target", "seq0", "seq")


@query("latest_fact_wins", sql("items", "SELECT target, arg_max(supplier, (date, seq, supplier, part)) AS supplier, arg_max(CASE WHEN seq % 2 = 0 THEN part END, (date, seq, supplier, part)) FILTER (seq % 2 = 0) AS part FROM items GROUP BY target"))
def latest_fact_wins(spark, sf):
    facts = t.items(spark, sf).select("target", "date", F.struct("seq", "supplier", "part").alias("seq"), "supplier", F.when(F.col("seq") % 2 == 0, F.col("part")).alias("part"))
    return R.latest_fact_wins(facts, "target", ["supplier", "part"])


@query("status_lifecycle", sql("items", "SELECT target AS id, arg_max(status, (date, CAST(status <> 'open' AS INTEGER), seq)) AS status, strftime(max(date), '%Y-%m-%d') AS status_date, count(*) AS mentions FROM (SELECT *, CASE WHEN part % 3 = 0 THEN 'done' ELSE 'open' END AS status FROM items) GROUP BY target"))
def status_lifecycle(spark, sf):
    events = t.items(spark, sf).select(F.col("target").alias("id"), "date", "seq", F.when(F.col("part") % 3 == 0, "done").otherwise("open").alias("status"))
    return R.status_lifecycle(events, "id").withColumn("status_date", F.col("status_date").cast("string"))


@query("human_edit_wins", sql("commitments", "SELECT id, CASE WHEN id % 7 = 0 THEN 'edited' ELSE status END AS status FROM commitments"))
def human_edit_wins(spark, sf):
    c = t.commitments(spark, sf)
    edits = c.where("id % 7 = 0").select("id", F.lit("edited").alias("status"), today().alias("date"), F.lit(1).alias("seq"))
    return R.latest_fact_wins(c.select("id", "status", "date", F.lit(0).alias("seq")).unionByName(edits), "id", ["status"])


@query("timeline_order", sql("items", "SELECT target, seq, row_number() OVER (PARTITION BY target ORDER BY date DESC, seq) AS place FROM items QUALIFY place <= 3"))
def timeline_order(spark, sf):
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("date"), "seq"))
    return t.items(spark, sf).withColumn("place", place.cast("bigint")).where("place <= 3").select("target", "seq", "place")


@query("stuck_backlog", sql("records", "SELECT strftime(min(d), '%Y-%m-%d') AS since, count(*) AS days_stuck, n FROM (SELECT d, n, d - CAST(row_number() OVER (PARTITION BY n ORDER BY d) AS INTEGER) AS g FROM (SELECT CAST(ts AS DATE) AS d, count(*) // 60 AS n FROM records GROUP BY 1)) GROUP BY n, g HAVING count(*) >= 3"))
def stuck_backlog(spark, sf):
    daily = t.records(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.floor(F.count("*") / 60).alias("n"))
    run = F.date_sub("d", F.row_number().over(Window.partitionBy("n").orderBy("d")))
    return daily.withColumn("g", run).groupBy("n", "g").agg(F.min("d").cast("string").alias("since"), F.count("*").alias("days_stuck")).where("days_stuck >= 3").select("since", "days_stuck", "n")


@query("due_commitments", sql("commitments", f"SELECT id, strftime(due, '%Y-%m-%d') AS due, due < {_TODAY} AS overdue FROM commitments WHERE status = 'open' AND direction = 'i_owe' AND due <= {_TODAY}"))
def due_commitments(spark, sf):
    c = t.commitments(spark, sf).where((F.col("status") == "open") & (F.col("direction") == "i_owe") & (F.col("due") <= today()))
    return c.select("id", F.col("due").cast("string").alias("due"), (F.col("due") < today()).alias("overdue"))


@query("view_commitments", sql("commitments", f"SELECT direction, id, CAST(date_diff('day', {_TODAY}, due) AS BIGINT) AS days_left FROM commitments WHERE status = 'open'"))
def view_commitments(spark, sf):
    return t.commitments(spark, sf).where("status = 'open'").select("direction", "id", F.datediff("due", today()).cast("bigint").alias("days_left"))


@query("follow_up_radar", sql("commitments", f"SELECT direction, count(*) AS open, count(*) FILTER (due = {_TODAY} + 1) AS due_tomorrow, count(*) FILTER (due < {_TODAY}) AS overdue FROM commitments WHERE status = 'open' GROUP BY direction"))
def follow_up_radar(spark, sf):
    return t.commitments(spark, sf).where("status = 'open'").groupBy("direction").agg(F.count("*").alias("open"), F.count_if(F.col("due") == F.date_add(today(), 1)).alias("due_tomorrow"), F.count_if(F.col("due") < today()).alias("overdue"))


@query("todays_meetings", sql("records", "SELECT id, r = 1 AS first FROM (SELECT id, row_number() OVER (ORDER BY ts, id) AS r FROM records WHERE kind = 'meeting' AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16')"))
def todays_meetings(spark, sf):
    day = F.lit("2024-01-15").cast("timestamp")
    m = t.records(spark, sf).where((F.col("kind") == "meeting") & (F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY")))
    first = m.agg(F.min(F.struct("ts", "id")).alias("f"))
    return m.join(F.broadcast(first), F.col("id") == F.col("f.id"), "left").select("id", F.col("f").isNotNull().alias("first"))


_ACTIVITY = "activity AS (SELECT p.id, max(i.date) AS last FROM projects p LEFT JOIN items i ON i.part = p.id GROUP BY p.id)"


@query("stalled_projects", sql("projects items", f"SELECT id, strftime(last, '%Y-%m-%d') AS last FROM activity WHERE date_diff('day', last, {_TODAY}) >= 14", _ACTIVITY))
def stalled_projects(spark, sf):
    last = t.items(spark, sf).groupBy(F.col("part").alias("id")).agg(F.max("date").alias("last"))
    return t.projects(spark, sf).join(last, "id").where(F.datediff(today(), "last") >= 14).select("id", F.col("last").cast("string").alias("last"))


@query("stale_projects", sql("projects items", f"SELECT id FROM activity WHERE last IS NULL OR last < {_TODAY} - 30", _ACTIVITY))
def stale_projects(spark, sf):
    last = t.items(spark, sf).groupBy(F.col("part").alias("id")).agg(F.max("date").alias("last"))
    return t.projects(spark, sf).join(last, "id", "left").where(F.col("last").isNull() | (F.col("last") < F.date_sub(today(), 30))).select("id")


@query("keep_warm", sql("records", "SELECT other AS handle, epoch_us(max(ts)) AS last_us FROM records GROUP BY other HAVING max(ts) < TIMESTAMP '2024-01-29' ORDER BY max(ts), other LIMIT 8"))
def keep_warm(spark, sf):
    last = t.records(spark, sf).groupBy(F.col("other").alias("handle")).agg(F.max("ts").alias("last")).where(F.col("last") < F.lit("2024-01-29").cast("timestamp"))
    return last.orderBy("last", "handle").limit(8).select("handle", F.unix_micros("last").alias("last_us"))


@query("opportunity_scan", sql("records", "SELECT id FROM (SELECT * FROM records WHERE ts >= TIMESTAMP '2024-01-25' ORDER BY ts DESC, id LIMIT 300) WHERE NOT is_from_me"))
def opportunity_scan(spark, sf):
    newest = t.records(spark, sf).where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")).orderBy(F.desc("ts"), "id").limit(300)
    return newest.where(~F.col("is_from_me")).select("id")


@query("open_opportunities", sql("projects", "SELECT id, title FROM projects WHERE size % 5 = 0"))
def open_opportunities(spark, sf):
    return t.projects(spark, sf).where("size % 5 = 0").select("id", "title")


@query("weekly_review", sql("records commitments", f"SELECT 'meetings' AS section, count(*) AS n FROM records WHERE kind = 'meeting' AND ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' UNION ALL SELECT 'inbound', count(*) FROM records WHERE NOT is_from_me AND ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' UNION ALL SELECT 'opened', count(*) FROM commitments WHERE date > {_TODAY} - 7 UNION ALL SELECT 'closed', count(*) FROM commitments WHERE status = 'done' AND date > {_TODAY} - 7"))
def weekly_review(spark, sf):
    r = t.records(spark, sf).where((F.col("ts") >= F.lit("2024-01-22").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-29").cast("timestamp")))
    c = t.commitments(spark, sf).where(F.col("date") > F.date_sub(today(), 7))
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
    return part(r.where("kind = 'meeting'"), "meetings").unionByName(part(r.where("not is_from_me"), "inbound")).unionByName(part(c, "opened")).unionByName(part(c.where("status = 'done'"), "closed"))


@query("update_status", sql("records", "SELECT kind, count(*) AS n, epoch_us(max(ts)) AS last_us FROM records GROUP BY kind"))
def update_status(spark, sf):
    return t.records(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("view_projects", sql("projects", "SELECT type, count(*) AS n, min(title) AS first FROM projects GROUP BY type"))
def view_projects(spark, sf):
    return t.projects(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.min("title").alias("first"))


@query("view_by_role", sql("projects", "SELECT id, title FROM projects WHERE type IN ('ECONOMY', 'PROMO') AND size = 10"))
def view_by_role(spark, sf):
    return t.projects(spark, sf).where(F.expr("type in ('ECONOMY', 'PROMO')") & F.expr("size = 10")).select("id", "title")


@query("index_lists", sql("commitments", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, greatest(count(*) - 300, 0) AS rest FROM commitments GROUP BY ALL"))
def index_lists(spark, sf):
    return t.commitments(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.greatest(F.count("*") - 300, F.lit(0)).alias("rest"))


@query("home_summary", sql("commitments projects contacts", "SELECT 'commitments' AS what, count(*) AS n FROM commitments UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'people', count(*) FROM contacts UNION ALL SELECT 'open', count(*) FROM commitments WHERE status = 'open'"))
def home_summary(spark, sf):
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    c = t.commitments(spark, sf)
    return part(c, "commitments").unionByName(part(t.projects(spark, sf), "projects")).unionByName(part(t.contacts(spark, sf), "people")).unionByName(part(c.where("status = 'open'"), "open"))


_KNOWN = """batches AS (SELECT DISTINCT id // 100 AS batch FROM commitments), who AS (SELECT DISTINCT id // 100 AS batch, counterpart AS p FROM commitments WHERE id % 400 >= 100),
people AS (SELECT c.card AS id, c.name AS title, c.company, coalesce(n, 0) AS strength FROM contacts c LEFT JOIN (SELECT counterpart, count(*) AS n FROM commitments GROUP BY counterpart) k ON k.counterpart = c.card),
strong AS (SELECT id, row_number() OVER (ORDER BY strength DESC, title, id) AS r FROM people),
mine AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY strength DESC, title, id) AS r FROM who JOIN people ON p = id),
both_ AS (SELECT batch, id, 0 AS part, r FROM mine WHERE r <= 300 UNION ALL SELECT b.batch, s.id, 1, s.r FROM batches b, strong s WHERE s.r <= 300 AND NOT EXISTS (SELECT 1 FROM mine m WHERE m.batch = b.batch AND m.id = s.id)),
told AS (SELECT batch, string_agg(id, ',' ORDER BY k) AS people, count(*) FILTER (k <= 120) AS detailed FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY part, r) AS k FROM both_) WHERE k <= 300 GROUP BY batch),
met AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ts DESC, id) AS k FROM (SELECT DISTINCT w.batch, m.id, m.ts FROM who w JOIN records m ON m.kind = 'meeting' AND m.user_id = w.p)),
latest AS (SELECT string_agg(id, ',' ORDER BY ts DESC, id) AS meetings FROM (SELECT id, ts FROM records WHERE kind = 'meeting' ORDER BY ts DESC, id LIMIT 20)),
held AS (SELECT batch, string_agg(id, ',' ORDER BY k) AS meetings FROM met WHERE k <= 20 GROUP BY batch),
owed AS (SELECT batch, string_agg(id, ',' ORDER BY k) AS commitments FROM (SELECT w.batch, m.id, row_number() OVER (PARTITION BY w.batch ORDER BY m.date DESC, m.id) AS k FROM who w JOIN commitments m ON m.counterpart = w.p AND m.status = 'open') WHERE k <= 80 GROUP BY batch),
chances AS (SELECT id, CASE WHEN id % 3 > 0 THEN id END AS counterpart, size FROM projects WHERE size > 10),
open_ AS (SELECT batch, string_agg(id, ',' ORDER BY k) AS opportunities FROM (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY size DESC, id) AS k FROM (SELECT w.batch, c.id, c.size FROM who w JOIN chances c ON c.counterpart = w.p UNION ALL SELECT b.batch, c.id, c.size FROM batches b, chances c WHERE c.counterpart IS NULL)) WHERE k <= 40 GROUP BY batch),
shared AS (SELECT (SELECT string_agg(company, ',' ORDER BY company) FROM (SELECT DISTINCT company FROM projects ORDER BY company LIMIT 300)) AS companies,
  (SELECT string_agg(title || ' ' || coalesce(CAST(seen AS VARCHAR), ''), ',' ORDER BY title, type, seen NULLS FIRST) FROM (SELECT p.title, p.type, max(i.date) AS seen FROM projects p LEFT JOIN items i ON i.part = p.id GROUP BY p.id, p.title, p.type ORDER BY p.title, p.type, seen NULLS FIRST LIMIT 200)) AS projects,
  (SELECT string_agg(id, ',' ORDER BY ts DESC, id) FROM (SELECT id, ts FROM notes ORDER BY ts DESC, id LIMIT 40)) AS answers)"""


@query("known_context", sql("commitments contacts records projects items notes", "SELECT b.batch, t.people, t.detailed, s.companies, s.projects, CASE WHEN EXISTS (SELECT 1 FROM mine m WHERE m.batch = b.batch) THEN coalesce(h.meetings, '') ELSE l.meetings END AS meetings, coalesce(o.commitments, '') AS commitments, coalesce(x.opportunities, '') AS opportunities, s.answers FROM batches b CROSS JOIN shared s CROSS JOIN latest l LEFT JOIN told t USING (batch) LEFT JOIN held h USING (batch) LEFT JOIN owed o USING (batch) LEFT JOIN open_ x USING (batch)", _KNOWN))
def known_context(spark, sf):
    """A batch is a hundred commitments; every fourth names no one."""
    m = t.commitments(spark, sf).withColumn("batch", F.expr("id div 100"))
    who = m.where("id % 400 >= 100").select("batch", F.col("counterpart").alias("person_id"))
    strength = m.groupBy(F.col("counterpart").alias("card")).agg(F.count("*").alias("strength"))
    people = t.contacts(spark, sf).join(strength, "card", "left").select(F.col("card").alias("id"), F.col("name").alias("title"), F.coalesce("strength", F.lit(0)).alias("strength"), F.array("name", "mail").alias("aliases"), "company")
    p = t.projects(spark, sf)
    seen = t.items(spark, sf).groupBy(F.col("part").alias("id")).agg(F.max("date").alias("last_activity"))
    meetings = t.records(spark, sf).where("kind = 'meeting'").select("id", F.col("thread").alias("title"), F.col("ts").alias("date"), F.array("user_id").alias("people"))
    chances = p.where("size > 10").select("id", "title", F.when(F.col("id") % 3 > 0, F.col("id")).alias("counterpart"), F.col("size").alias("date"), F.lit("open").alias("status"))
    owed = m.select("id", "direction", "counterpart", "date", "due", "status", F.col("direction").alias("text"))
    context = known_context_of(m, who, people, p.select(F.col("company").alias("title")), p.join(seen, "id", "left").select("title", F.col("type").alias("status"), "last_activity"), meetings, owed, chances, t.notes(spark, sf).select("id", "text", F.col("ts").alias("at")))
    said = lambda c, f: F.array_join(F.transform(c, f), ",")
    ids = lambda c: said(c, lambda x: x["id"].cast("string")).alias(c)
    project = lambda x: F.concat(x["title"], F.lit(" "), F.coalesce(x["last_activity"].cast("string"), F.lit("")))
    detailed = F.size(F.filter("people", lambda x: x["company"].isNotNull())).cast("bigint")
    return context.select("batch", ids("people"), detailed.alias("detailed"), said("companies", lambda x: x["title"]).alias("companies"), said("projects", project).alias("projects"), ids("meetings"), ids("commitments"), ids("opportunities"), ids("answers"))


@query("identity_samples", sql("thread_records", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY ts DESC, id) AS k2 FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY ts DESC, id) AS k FROM thread_records) WHERE k <= 12 AND length(text) >= 12) WHERE k2 <= 3"))
def identity_samples(spark, sf):
    by = Window.partitionBy("sender").orderBy(F.desc("ts"), "id")
    last = t.thread_records(spark, sf).withColumn("k", F.row_number().over(by)).where((F.col("k") <= 12) & (F.length("text") >= 12))
    return last.withColumn("k2", F.row_number().over(by)).where("k2 <= 3").select("id")


@query("recent_answers", sql("commitments", "SELECT id FROM commitments WHERE status = 'done' ORDER BY date DESC, id LIMIT 40"))
def recent_answers(spark, sf):
    return t.commitments(spark, sf).where("status = 'done'").orderBy(F.desc("date"), "id").limit(40).select("id")


@query("array_union_fields", sql("items", "SELECT target, array_to_string(list_sort(list(DISTINCT part))[1:40], ',') AS parts FROM items GROUP BY target"))
def array_union_fields(spark, sf):
    x = t.items(spark, sf).groupBy("target").agg(F.slice(F.array_sort(F.collect_set("part")), 1, 40).alias("p"))
    return x.select("target", F.array_join(F.col("p").cast("array<string>"), ",").alias("parts"))


@query("participants_union", sql("records thread_records", "SELECT other AS who FROM records UNION SELECT sender FROM thread_records"))
def participants_union(spark, sf):
    return t.records(spark, sf).select(F.col("other").alias("who")).union(t.thread_records(spark, sf).select("sender")).distinct()


@query("people_except_excluded", sql("thread_records", "SELECT DISTINCT sender FROM thread_records EXCEPT SELECT unnest(['tel:+22395', 'mailto:owner@example.com'])"))
def people_except_excluded(spark, sf):
    return t.thread_records(spark, sf).select("sender").distinct().where(~F.col("sender").isin("tel:+22395", t.OWNER))


@query("review_dedupe_union", sql("projects", "SELECT company, min(id) AS id, count(*) AS asked FROM projects GROUP BY company"))
def review_dedupe_union(spark, sf):
    return t.projects(spark, sf).groupBy("company").agg(F.min("id").alias("id"), F.count("*").alias("asked"))


@query("unreviewed_except", sql("projects", "SELECT DISTINCT title FROM projects WHERE size < 10 EXCEPT SELECT title FROM projects WHERE size > 45"))
def unreviewed_except(spark, sf):
    p = t.projects(spark, sf)
    return p.where("size < 10").select("title").distinct().join(p.where("size > 45").select("title").distinct(), "title", "left_anti")


@query("mention_promotion", sql("items projects", "SELECT part AS key, count(DISTINCT target) AS items, p.size > 40 AS known FROM items i JOIN projects p ON p.id = i.part GROUP BY part, p.size HAVING count(DISTINCT target) >= 2 OR p.size > 40"))
def mention_promotion(spark, sf):
    known = t.projects(spark, sf).where("size > 40").select(F.col("id").alias("key"))
    return R.mention_promotion(t.items(spark, sf).select(F.col("part").alias("key"), F.col("target").alias("item")), known)


@query("exact_duplicates", sql("projects", "SELECT id, copies, keep_id FROM (SELECT id, count(*) OVER w AS copies, first_value(id) OVER (PARTITION BY title, company ORDER BY size DESC, id) AS keep_id FROM projects WINDOW w AS (PARTITION BY title, company)) WHERE copies > 1"))
def exact_duplicates(spark, sf):
    return R.exact_duplicates(t.projects(spark, sf), ["title", "company"], [F.desc("size"), F.col("id")]).select("id", "copies", "keep_id")


@query("fold_duplicates", sql("projects items", "SELECT keep AS id, count(*) AS bullets FROM (SELECT id, first_value(id) OVER (PARTITION BY title, company ORDER BY size DESC, id) AS keep FROM projects) p JOIN items i ON i.part = p.id GROUP BY keep"))
def fold_duplicates(spark, sf):
    order = Window.partitionBy("title", "company").orderBy(F.desc("size"), "id")
    mapping = t.projects(spark, sf).select(F.col("id").alias("part"), F.first("id").over(order).alias("keep"))
    return t.items(spark, sf).join(mapping, "part").groupBy(F.col("keep").alias("id")).agg(F.count("*").alias("bullets"))


@query("provenance_count", sql("items", "SELECT target, count(DISTINCT ref) AS refs, arg_max(ref, (date, seq, ref)) AS newest FROM items GROUP BY target"))
def provenance_count(spark, sf):
    return t.items(spark, sf).groupBy("target").agg(F.count_distinct("ref").alias("refs"), F.max_by("ref", F.struct("date", "seq", "ref")).alias("newest"))


@query("cleanup_summary", sql("projects commitments", f"SELECT 'duplicates' AS finding, count(*) AS n FROM (SELECT title, company FROM projects GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'overdue', count(*) FROM commitments WHERE status = 'open' AND due < {_TODAY}"))
def cleanup_summary(spark, sf):
    dup = t.projects(spark, sf).groupBy("title", "company").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("duplicates").alias("finding"), "n")
    late = t.commitments(spark, sf).where((F.col("status") == "open") & (F.col("due") < today())).agg(F.count("*").alias("n")).select(F.lit("overdue").alias("finding"), "n")
    return dup.unionByName(late)


@query("value_counts", sql("commitments", "SELECT count(*) AS tracked, count(*) FILTER (status = 'done') AS done, count(*) FILTER (direction = 'i_owe') AS owed FROM commitments"))
def value_counts(spark, sf):
    return t.commitments(spark, sf).agg(F.count("*").alias("tracked"), F.count_if(F.expr("status = 'done'")).alias("done"), F.count_if(F.expr("direction = 'i_owe'")).alias("owed"))


@query("ledger_counts", sql("commitments", "SELECT direction AS scope, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'dropped') AS dropped FROM commitments GROUP BY direction"))
def ledger_counts(spark, sf):
    return t.commitments(spark, sf).groupBy(F.col("direction").alias("scope")).pivot("status", ["open", "done", "dropped"]).agg(F.count(F.lit(1))).na.fill(0)


@query("source_freshness", sql("records", "SELECT kind AS source, CAST(floor(epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600) AS BIGINT) AS hours, epoch(TIMESTAMP '2024-02-01' - max(ts)) > 7 * 3600 AS late FROM records GROUP BY kind"))
def source_freshness(spark, sf):
    age = F.unix_micros(F.lit(t.NOW).cast("timestamp")) - F.unix_micros(F.max("ts"))
    return t.records(spark, sf).groupBy(F.col("kind").alias("source")).agg(F.floor(age / 3_600_000_000).alias("hours"), (age > 7 * 3_600_000_000).alias("late"))


@query("backlog_estimate", sql("notes", "SELECT CAST(ceil(0.6 * sum(least(length(text), 1500) + 80) / 4 / 40000) AS BIGINT) AS batches FROM notes WHERE ts < TIMESTAMP '2024-01-20'"))
def backlog_estimate(spark, sf):
    n = t.notes(spark, sf).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    return n.agg(F.ceil(F.lit(0.6) * F.sum(F.least(F.length("text"), F.lit(1500)) + 80) / 4 / 40_000).alias("batches"))


@query("earliest_record", sql("records", "SELECT epoch_us(min(ts)) AS first_us FROM records WHERE kind <> 'event'"))
def earliest_record(spark, sf):
    return t.records(spark, sf).where("kind <> 'event'").agg(F.unix_micros(F.min("ts")).alias("first_us"))


@query("message_size_stats", sql("thread_records", "SELECT conv_id, count(DISTINCT role) AS speakers, CAST(sum(length(text)) AS BIGINT) AS chars FROM thread_records GROUP BY conv_id"))
def message_size_stats(spark, sf):
    return t.thread_records(spark, sf).groupBy("conv_id").agg(F.count_distinct("role").alias("speakers"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("dossier_stats", sql("records", "SELECT CASE WHEN kind = 'call' AND duration_s < 30 THEN 'trivia' WHEN kind = 'event' THEN 'context' ELSE 'used' END AS outcome, count(*) AS n FROM records GROUP BY ALL"))
def dossier_stats(spark, sf):
    outcome = F.when((F.col("kind") == "call") & (F.col("duration_s") < 30), "trivia").when(F.col("kind") == "event", "context").otherwise("used")
    return t.records(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("route_records", sql("records", "SELECT CASE kind WHEN 'meeting' THEN 'meeting' WHEN 'event' THEN 'out' WHEN 'call' THEN CASE WHEN duration_s >= 30 THEN 'person' ELSE 'out' END ELSE 'person' END AS bucket, count(*) AS n FROM records GROUP BY ALL"))
def route_records(spark, sf):
    bucket = F.when(F.col("kind") == "meeting", "meeting").when(F.col("kind") == "event", "out").when((F.col("kind") == "call") & (F.col("duration_s") < 30), "out").otherwise("person")
    return t.records(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("assemble_person_dossiers", sql("records", "SELECT other, count(*) AS items, string_agg(id, ',' ORDER BY ts, id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY ts DESC, id DESC) AS r FROM records WHERE kind IN ('message', 'email')) WHERE r <= 20 GROUP BY other"))
def assemble_person_dossiers(spark, sf):
    lines = t.records(spark, sf).where("kind in ('message', 'email')").select("other", "id", "ts")
    kept = R.newest_within_budget(lines, "other", F.lit(1), 20)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"])
    return kept.groupBy("other").agg(F.count("*").alias("items"), F.array_join(ordered, ",").alias("ids"))


@query("merge_commitments", sql("commitments", f"SELECT left(sha1(direction || '|' || counterpart || '|' || id), 16) AS fp, status FROM (SELECT {norm('direction')} AS direction, counterpart, id, status FROM commitments)"))
def merge_commitments(spark, sf):
    c = t.commitments(spark, sf)
    facts = c.select(T.fingerprint(F.col("direction"), F.col("counterpart"), F.col("id")).alias("fp"), "status", "date", F.lit(0).alias("seq"))
    return R.status_lifecycle(facts, "fp").select("fp", "status")


@query("merge_companies", sql("projects", "SELECT company AS key, max(size) AS size, count(*) AS n FROM projects GROUP BY company"))
def merge_companies(spark, sf):
    return t.projects(spark, sf).groupBy(F.col("company").alias("key")).agg(F.max("size").alias("size"), F.count("*").alias("n"))


@query("merge_projects", sql("projects items", "SELECT p.id, arg_max(i.supplier, (i.date, i.target, i.seq, i.supplier)) AS supplier FROM projects p JOIN items i ON i.part = p.id GROUP BY p.id"))
def merge_projects(spark, sf):
    facts = t.items(spark, sf).select(F.col("part").alias("id"), "supplier", "date", F.struct("target", "seq", "supplier").alias("seq"))
    return R.latest_fact_wins(facts, "id", ["supplier"])


@query("mention_dates", sql("items", "SELECT part, date_text, array_to_string(list_sort(list(DISTINCT target)), ',') AS refs FROM (SELECT *, strftime(date, '%Y-%m-%d') AS date_text FROM items) GROUP BY part, date_text"))
def mention_dates(spark, sf):
    x = t.items(spark, sf).groupBy("part", F.col("date").cast("string").alias("date_text")).agg(F.array_sort(F.collect_set("target")).alias("r"))
    return x.select("part", "date_text", F.array_join(F.col("r").cast("array<string>"), ",").alias("refs"))


@query("create_entity", sql("items contacts", "SELECT DISTINCT supplier AS id FROM items WHERE supplier NOT IN (SELECT card FROM contacts WHERE card % 2 = 0)"))
def create_entity(spark, sf):
    known = t.contacts(spark, sf).where("card % 2 = 0").select(F.col("card").alias("id"))
    return t.items(spark, sf).select(F.col("supplier").alias("id")).distinct().join(known, "id", "left_anti")


@query("batch_identity", sql("items", "SELECT target, left(sha1(string_agg(ref, '|' ORDER BY seq, ref)), 8) AS batch FROM items GROUP BY target"))
def batch_identity(spark, sf):
    refs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref"))), lambda x: x["ref"])
    return t.items(spark, sf).groupBy("target").agg(F.left(F.sha1(F.array_join(refs, "|")), F.lit(8)).alias("batch"))


@query("restore_run", sql("commitments", "SELECT id, status FROM commitments WHERE id % 5 <> 1"))
def restore_run(spark, sf):
    c = t.commitments(spark, sf).select("id", "status")
    now = c.withColumn("status", F.when(F.col("id") % 5 == 0, "changed").otherwise(F.col("status")))
    before = F.when(F.col("id") % 5 == 0, F.struct("status"))
    changes = c.where("id % 5 < 2").select(F.lit("run1").alias("run_id"), "id", before.alias("before"))
    return R.restore_run(now, changes, "run1")


@query("changed_since", sql("records", "SELECT id FROM records WHERE ts > TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-05'"))
def changed_since(spark, sf):
    r = t.records(spark, sf).withColumn("changed_at", F.col("ts"))
    return R.records_scan(r, since=F.lit("2024-01-05").cast("timestamp"), changed_since=F.lit("2024-01-20").cast("timestamp")).select("id")


@query("watermark_mark_cursor", sql("records", "SELECT id FROM records WHERE (ts, id) > (TIMESTAMP '2024-01-20', 'events:5')"))
def watermark_mark_cursor(spark, sf):
    mark = F.struct(F.lit("2024-01-20").cast("timestamp").alias("ts"), F.lit("events:5").alias("id"))
    return t.records(spark, sf).where(F.struct("ts", "id") > mark).select("id")


@query("watermark_key_cursor", sql("items", "SELECT target, seq FROM items WHERE target > 5000 OR target < 100"))
def watermark_key_cursor(spark, sf):
    return t.items(spark, sf).where("target > 5000 or target < 100").select("target", "seq")


@query("tumbling_backlog", sql("commitments", "SELECT CAST(date_diff('day', DATE '1995-01-01', date) // 30 AS BIGINT) AS step, count(*) AS n FROM commitments GROUP BY ALL"))
def tumbling_backlog(spark, sf):
    w = F.window(F.col("date").cast("timestamp"), "30 days", startTime="0 seconds")
    step = F.floor(F.datediff("date", F.lit("1995-01-01").cast("date")) / 30)
    return t.commitments(spark, sf).groupBy(step.alias("step")).agg(F.count("*").alias("n"))


@query("initial_window", sql("records", "SELECT count(*) AS n FROM records WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 60 DAY"))
def initial_window(spark, sf):
    return t.records(spark, sf).where(F.col("ts") >= F.lit(t.NOW).cast("timestamp") - F.expr("INTERVAL 60 DAYS")).agg(F.count("*").alias("n"))


@query("weekly_tumbling_notes", sql("notes", "SELECT source, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM notes GROUP BY ALL"))
def weekly_tumbling_notes(spark, sf):
    from threadloom.functions.dates import iso_week

    return t.notes(spark, sf).groupBy("source", iso_week(F.to_date("ts")).alias("week")).agg(F.count("*").alias("n"))


@query("active_days_window", sql("records", "SELECT other, count(DISTINCT CAST(ts AS DATE)) AS days FROM records WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 365 DAY GROUP BY other"))
def active_days_window(spark, sf):
    return t.records(spark, sf).where(F.col("ts") >= F.lit(t.NOW).cast("timestamp") - F.expr("INTERVAL 365 DAYS")).groupBy("other").agg(F.count_distinct(F.to_date("ts")).alias("days"))


@query("sliding_send_count", sql("records", "SELECT id, count(*) OVER (PARTITION BY other ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day FROM (SELECT id, other, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records WHERE is_from_me)"))
def sliding_send_count(spark, sf):
    by = Window.partitionBy("other").orderBy("s").rangeBetween(-86_400, 0)
    return t.records(spark, sf).where("is_from_me").withColumn("s", F.unix_seconds("ts")).select("id", F.count("*").over(by).alias("day"))


@query("batch_ledger_state", sql("items", "SELECT target, arg_max(CASE supplier % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'written' ELSE 'merged' END, (date, seq, supplier)) AS status, count(*) AS attempts FROM items GROUP BY target HAVING count(*) < 3"))
def batch_ledger_state(spark, sf):
    status = F.when(F.col("supplier") % 3 == 0, "pending").when(F.col("supplier") % 3 == 1, "written").otherwise("merged")
    return t.items(spark, sf).withColumn("status", status).groupBy("target").agg(F.max_by("status", F.struct("date", "seq", "supplier")).alias("status"), F.count("*").alias("attempts")).where("attempts < 3")


@query("calendar_refresh_window", sql("records", "SELECT id FROM records WHERE kind = 'meeting' AND (ts > TIMESTAMP '2024-01-28' OR ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-20')"))
def calendar_refresh_window(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp")
    return t.records(spark, sf).where((F.col("kind") == "meeting") & ((F.col("ts") > at("2024-01-28")) | F.col("ts").between(at("2024-01-14"), at("2024-01-20")))).select("id")


@query("notes_per_folder", sql("notes", "SELECT source, count(*) AS n FROM notes GROUP BY source"))
def notes_per_folder(spark, sf):
    return t.notes(spark, sf).groupBy("source").agg(F.count("*").alias("n"))


@query("entity_mention_join", sql("projects", "SELECT a.title, count(*) AS mentions FROM (SELECT DISTINCT title FROM projects) a JOIN projects p ON p.title = a.title GROUP BY a.title"))
def entity_mention_join(spark, sf):
    from threadloom.operators.mentions import entity_mentions

    names = t.projects(spark, sf).select(F.col("title").alias("name")).distinct()
    texts = t.projects(spark, sf).select("id", F.concat_ws(" ", F.lit("about the"), "title", F.lit("today")).alias("text"))
    return entity_mentions(texts, names).groupBy(F.col("name").alias("title")).agg(F.count("*").alias("mentions"))
