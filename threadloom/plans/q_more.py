"""More queries: single privacy rules, small views, merging steps and source joins, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.operators import privacy as P
from threadloom.operators import records as R
from threadloom.operators.pairs import probable_duplicates, similar_classes
from threadloom.plans import tables as t
from threadloom.plans.q_people import _STATS, _STRONG, people
from threadloom.plans.q_scalar import jaccard_sql, norm, words
from threadloom.plans.q_views import _TODAY, today
from threadloom.plans.tables import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


def _case(*texts: str):
    """A text for each project id, in turn."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % len(texts) + 1).cast("int"))


def _filtered(spark, sf, exclusions, **columns):
    base = {"account": F.lit(None).cast("string"), "chat": F.lit(None).cast("string"), "sender": F.lit("tel:+15551234567"), "sender_name": F.lit(None).cast("string"), "title": F.lit(""), "text": F.lit(""), "kind": F.lit("message"), "members": F.lit(2), "thread": F.col("company")}
    return P.filter_record(t.projects(spark, sf).withColumns(base | columns), exclusions)


@query("rule_mail_account", sql("projects", "SELECT id, id % 2 = 1 AS keep FROM projects"))
def rule_mail_account(spark, sf):
    return _filtered(spark, sf, {"accounts": ["me@x.com"]}, account=_case("me@x.com", "work@x.com")).select("id", "keep")


@query("rule_chat", sql("projects", "SELECT id, CASE WHEN id % 2 = 0 THEN 'thread' END AS scope FROM projects"))
def rule_chat(spark, sf):
    return _filtered(spark, sf, {"chats": ["book club"]}, chat=_case("Book  Club", "Bookings")).select("id", "scope")


@query("rule_conversation_size", sql("projects", "SELECT id, CASE id % 3 WHEN 0 THEN 'thread' ELSE 'record' END AS scope FROM projects"))
def rule_conversation_size(spark, sf):
    members = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, 8)
    return _filtered(spark, sf, {"handles": ["tel:+15551234567"]}, members=members).select("id", "scope")


@query("rule_non_conversation", sql("projects", "SELECT id, CASE id % 2 WHEN 0 THEN 'record' ELSE 'thread' END AS scope FROM projects"))
def rule_non_conversation(spark, sf):
    return _filtered(spark, sf, {"handles": ["tel:+15551234567"]}, kind=_case("meeting", "message")).select("id", "scope")


@query("excluded_name", sql("projects", "SELECT id, id % 4 < 3 AS hit FROM projects"))
def excluded_name(spark, sf):
    return t.projects(spark, sf).select("id", P.name_matches(_case("Ann Lee", "ann lee jones", "Lee, Ann", "Annabel Lee"), ["ann lee"]).alias("hit"))


@query("source_spoof_guard", sql("records", "SELECT kind, count(*) AS n FROM records WHERE id LIKE 'events:%' GROUP BY kind"))
def source_spoof_guard(spark, sf):
    r = t.records(spark, sf)
    return r.where((F.col("source") == "events") & F.col("id").startswith("events:")).groupBy("kind").agg(F.count("*").alias("n"))


@query("is_bulk_mail", sql("projects", "SELECT id, id % 3 < 2 AS bulk FROM projects"))
def is_bulk_mail(spark, sf):
    meta = _case('{"List-Id":"<x>"}', '{"Precedence":"bulk"}', '{"Precedence":"first-class"}')
    keys = F.json_object_keys(meta)
    bulk = F.exists(keys, lambda k: F.lower(k).startswith("list-")) | F.coalesce(F.lower(F.get_json_object(meta, "$.Precedence")).isin("bulk", "list", "junk"), F.lit(False))
    return t.projects(spark, sf).select("id", bulk.alias("bulk"))


@query("meeting_is_substantive", sql("thread_records", "SELECT conv_id, sum(length(text)) >= 200 AND (count(DISTINCT role) >= 2 OR count(*) >= 3) AS ok FROM thread_records GROUP BY conv_id"))
def meeting_is_substantive(spark, sf):
    m = t.thread_records(spark, sf).groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count_distinct("role").alias("people"), F.count("*").alias("minutes"))
    return m.select("conv_id", ((F.col("chars") >= 200) & ((F.col("people") >= 2) | (F.col("minutes") >= 3))).alias("ok"))


@query("event_attendee_filter", sql("items", "SELECT target, count(DISTINCT supplier) AS people FROM items GROUP BY target HAVING count(DISTINCT supplier) BETWEEN 1 AND 10"))
def event_attendee_filter(spark, sf):
    return t.items(spark, sf).groupBy("target").agg(F.count_distinct("supplier").alias("people")).where("people between 1 and 10")


@query("contribution_id_check", sql("items commitments", "SELECT DISTINCT target FROM items WHERE target NOT IN (SELECT id FROM commitments WHERE status = 'open')"))
def contribution_id_check(spark, sf):
    return t.items(spark, sf).select("target").distinct().join(t.commitments(spark, sf).where("status = 'open'").select(F.col("id").alias("target")), "target", "left_anti")


@query("is_owner_party", sql("thread_records", "SELECT sender = 'mailto:owner@example.com' AS owner, count(*) AS n FROM thread_records GROUP BY ALL"))
def is_owner_party(spark, sf):
    return t.thread_records(spark, sf).groupBy((F.col("sender") == t.OWNER).alias("owner")).agg(F.count("*").alias("n"))


@query("last10", sql("records", "SELECT DISTINCT other, CASE WHEN other LIKE 'tel:%' THEN right(other, 10) END AS tail FROM records"))
def last10(spark, sf):
    return t.records(spark, sf).select("other", H.last10(F.col("other")).alias("tail")).distinct()


@query("email_domain", sql("records", "SELECT DISTINCT other, CASE WHEN other LIKE 'mailto:%' THEN split_part(other, '@', 2) END AS domain FROM records"))
def email_domain(spark, sf):
    return t.records(spark, sf).select("other", H.email_domain(F.col("other")).alias("domain")).distinct()


@query("mask_handle", sql("records", "SELECT DISTINCT other, CASE WHEN other LIKE 'tel:%' THEN 'tel:...' || right(other, 4) ELSE other END AS masked FROM records"))
def mask_handle(spark, sf):
    return t.records(spark, sf).select("other", H.mask_handle(F.col("other")).alias("masked")).distinct()


@query("fold_accents", "SELECT doc_id, translate(text, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY') AS folded FROM documents")
def fold_accents(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("name_tokens", sql("projects", f"SELECT id, length(string_split({norm('title')}, ' ')) AS tokens FROM projects"))
def name_tokens(spark, sf):
    return t.projects(spark, sf).select("id", F.size(T.name_tokens(F.col("title"))).alias("tokens"))


@query("looks_like_handle", sql("projects", "SELECT id, id % 3 < 2 AS handle FROM projects"))
def looks_like_handle(spark, sf):
    return t.projects(spark, sf).select("id", T.looks_like_handle(_case("ann@x.com", "+1 (555) 123-4567", "Ann Lee")).alias("handle"))


@query("record_hash")
def record_hash(spark, sf):
    return t.records(spark, sf).select("id", T.record_hash("ts", "kind", "thread", "other").alias("hash"))


@query("trim_quoted", sql("projects", "SELECT id, title AS own FROM projects"))
def trim_quoted(spark, sf):
    return t.projects(spark, sf).select("id", T.clean_email_text(F.concat("title", F.lit("\n-----Original Message-----\nFrom: x\nold"))).alias("own"))


@query("quote_line")
def quote_line(spark, sf):
    return P.scrub_text(t.read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.left(T.one_line(F.col("scrubbed")), F.lit(160)).alias("quote"))


@query("summary_text", sql("projects", "SELECT id, title AS summary FROM projects"))
def summary_text(spark, sf):
    meta = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("title").alias("summary")))).otherwise(F.to_json(F.struct(F.struct(F.col("title").alias("overview")).alias("summary"))))
    return t.projects(spark, sf).select("id", F.coalesce(F.get_json_object(meta, "$.summary.overview"), F.get_json_object(meta, "$.summary.text"), F.get_json_object(meta, "$.summary")).alias("summary"))


@query("action_items", sql("thread_records", "SELECT conv_id, least(count(*), 30) AS items FROM thread_records GROUP BY conv_id"))
def action_items(spark, sf):
    return t.thread_records(spark, sf).groupBy("conv_id").agg(F.size(F.slice(F.transform(F.collect_list("text"), T.one_line), 1, 30)).cast("bigint").alias("items"))


@query("days_ago", sql("records", "SELECT count(*) AS n FROM records WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY"))
def days_ago(spark, sf):
    return t.records(spark, sf).where(F.col("ts") >= F.lit(t.NOW).cast("timestamp") - F.make_dt_interval(F.lit(10))).agg(F.count("*").alias("n"))


@query("party_of", sql("contacts", "SELECT card, CASE WHEN card % 2 = 0 THEN mail ELSE 'name:' || lower(name) END AS handle FROM contacts"))
def party_of(spark, sf):
    mail = F.when(F.col("card") % 2 == 0, H.value(F.col("mail")))
    return t.contacts(spark, sf).select("card", F.coalesce(H.email_handle(mail), H.name_handle(F.col("name"))).alias("handle"))


@query("parse_front_matter", sql("projects", "SELECT id, title, company, 'body ' || id AS body FROM projects"))
def parse_front_matter(spark, sf):
    note = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ncompany: "), "company", F.lit("\n---\nbody "), F.col("id").cast("string"))
    head = F.regexp_extract(note, r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.str_to_map(head, F.lit("\n"), F.lit(": "))
    return t.projects(spark, sf).select("id", pairs["title"].alias("title"), pairs["company"].alias("company"), F.regexp_replace(note, r"(?s)^---\n.*?\n---\n", "").alias("body"))


@query("section_text", sql("projects", "SELECT id, title AS section FROM projects"))
def section_text(spark, sf):
    note = F.concat(F.lit("top\n<!-- a:start -->\n"), "title", F.lit("\n<!-- a:end -->\nrest"))
    return t.projects(spark, sf).select("id", T.section_text(note, "<!-- a:start -->", "<!-- a:end -->").alias("section"))


@query("section_bullets", sql("items", "SELECT target, count(*) AS bullets, strftime(max(date), '%Y-%m-%d') AS newest FROM items GROUP BY target"))
def section_bullets(spark, sf):
    line = F.concat(F.lit("- "), F.col("date").cast("string"), F.lit(" "), "ref")
    note = t.items(spark, sf).groupBy("target").agg(F.concat(F.lit("## Timeline\n"), F.array_join(F.collect_list(line), "\n")).alias("body"))
    dates = F.regexp_extract_all("body", F.lit(r"(?m)^- (\d{4}-\d{2}-\d{2}) "), F.lit(1))
    return note.select("target", F.size(dates).cast("bigint").alias("bullets"), F.array_max(dates).alias("newest"))


@query("personal_prose", sql("projects", "SELECT id, 'mine ' || title AS own FROM projects"))
def personal_prose(spark, sf):
    note = F.concat(F.lit("# Title\nmine "), "title", F.lit("\n<!-- x:start -->\nmade\n<!-- x:end -->"))
    return t.projects(spark, sf).select("id", F.trim(F.regexp_replace(F.regexp_replace(note, r"(?s)<!-- x:start -->.*?<!-- x:end -->", ""), r"(?m)^# .*\n", "").alias("s")).alias("own")).withColumn("own", F.regexp_replace("own", r"\n+$", ""))


@query("view_opportunities", sql("projects", "SELECT type, count(*) FILTER (size % 2 = 0) AS open, count(*) FILTER (size % 2 = 1) AS closed FROM projects GROUP BY type"))
def view_opportunities(spark, sf):
    return t.projects(spark, sf).groupBy("type").agg(F.count_if(F.col("size") % 2 == 0).alias("open"), F.count_if(F.col("size") % 2 == 1).alias("closed"))


@query("view_people", sql("records", "SELECT handle, tier FROM tiers WHERE tier IN ('inner', 'active')", _STATS + ",\n" + _STRONG))
def view_people(spark, sf):
    return people(spark, sf).where("tier in ('inner', 'active')").select("handle", "tier")


@query("meeting_prep", sql("records items", "SELECT r.id, count(i.ref) AS bullets FROM records r JOIN (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY date DESC, target, seq, part) AS k FROM items) i ON i.supplier = r.user_id AND i.k <= 3 WHERE r.kind = 'meeting' AND r.ts >= TIMESTAMP '2024-01-28' GROUP BY r.id"))
def meeting_prep(spark, sf):
    k = F.row_number().over(Window.partitionBy("supplier").orderBy(F.desc("date"), "target", "seq", "part"))
    last = t.items(spark, sf).withColumn("k", k).where("k <= 3").select(F.col("supplier").alias("user_id"), "ref")
    soon = t.records(spark, sf).where((F.col("kind") == "meeting") & (F.col("ts") >= F.lit("2024-01-28").cast("timestamp")))
    return soon.join(last, "user_id").groupBy("id").agg(F.count("ref").alias("bullets"))


@query("status_report", sql("records notes", "SELECT 'records' AS part, kind AS name, count(*) AS n FROM records GROUP BY kind UNION ALL SELECT 'notes', source, count(*) FROM notes GROUP BY source"))
def status_report(spark, sf):
    a = t.records(spark, sf).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("records").alias("part"), F.col("kind").alias("name"), "n")
    return a.unionByName(t.notes(spark, sf).groupBy("source").agg(F.count("*").alias("n")).select(F.lit("notes").alias("part"), F.col("source").alias("name"), "n"))


@query("health_report", sql("records commitments", f"SELECT 'late_source' AS problem, count(*) AS n FROM (SELECT kind FROM records GROUP BY kind HAVING max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 7 HOUR) UNION ALL SELECT 'overdue', count(*) FROM commitments WHERE status = 'open' AND due < {_TODAY}"))
def health_report(spark, sf):
    late = t.records(spark, sf).groupBy("kind").agg(F.max("ts").alias("last")).where(F.col("last") < F.lit(t.NOW).cast("timestamp") - F.expr("INTERVAL 7 HOURS"))
    due = t.commitments(spark, sf).where((F.col("status") == "open") & (F.col("due") < today()))
    return late.agg(F.count("*").alias("n")).select(F.lit("late_source").alias("problem"), "n").unionByName(due.agg(F.count("*").alias("n")).select(F.lit("overdue").alias("problem"), "n"))


@query("review_open_count", sql("commitments", "SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status <> 'open') AS resolved FROM commitments"))
def review_open_count(spark, sf):
    return t.commitments(spark, sf).agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") != "open").alias("resolved"))


@query("source_probe", sql("records", "SELECT s AS kind, CASE WHEN count(r.id) = 0 THEN 'no_data' ELSE 'ok' END AS reason FROM (SELECT unnest(['message', 'email', 'dictation']) AS s) k LEFT JOIN records r ON r.kind = k.s GROUP BY s"))
def source_probe(spark, sf):
    known = spark.createDataFrame([("message",), ("email",), ("dictation",)], "kind string")
    n = t.records(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))
    return known.join(n, "kind", "left").select("kind", F.when(F.col("n").isNull(), "no_data").otherwise("ok").alias("reason"))


@query("run_read_stats", sql("records", "SELECT count(*) AS total, count(CASE WHEN duration_s > 50 THEN 1 END) AS opened FROM records WHERE ts >= TIMESTAMP '2024-01-20'"))
def run_read_stats(spark, sf):
    return t.records(spark, sf).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).agg(F.count("*").alias("total"), F.count_if(F.col("duration_s") > 50).alias("opened"))


@query("session_count", sql("records", "SELECT count(DISTINCT thread) AS n FROM records WHERE ts >= TIMESTAMP '2024-01-28'"))
def session_count(spark, sf):
    return t.records(spark, sf).where(F.col("ts") >= F.lit("2024-01-28").cast("timestamp")).agg(F.count_distinct("thread").alias("n"))


@query("merge_exclusions", sql("contacts", "SELECT company, CAST(count(DISTINCT card % 10) AS BIGINT) AS listed FROM contacts GROUP BY company"))
def merge_exclusions(spark, sf):
    c = t.contacts(spark, sf).groupBy("company").agg(F.collect_set(F.when(F.col("card") % 2 == 0, F.col("card") % 10)).alias("a"), F.collect_set(F.when(F.col("card") % 2 == 1, F.col("card") % 10)).alias("b"))
    return c.select("company", F.size(F.array_union("a", "b")).cast("bigint").alias("listed"))


@query("resolve_person_join", sql("commitments contacts", "SELECT m.id, CASE WHEN m.id % 2 = 0 THEN m.counterpart ELSE c.card END AS person FROM commitments m LEFT JOIN contacts c ON c.card = m.counterpart"))
def resolve_person_join(spark, sf):
    """By id first, then by the one person of that name."""
    c = t.contacts(spark, sf)
    unique = c.groupBy(T.name_norm(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.min("card").alias("by_name")).where("n = 1")
    name = T.name_norm(F.concat(F.lit("Customer#"), F.lpad(F.col("counterpart").cast("string"), 9, "0")))
    m = t.commitments(spark, sf).withColumns({"by_id": F.when(F.col("id") % 2 == 0, F.col("counterpart")), "key": name})
    return m.join(unique, "key", "left").select("id", F.coalesce("by_id", "by_name").alias("person"))


_NAMES = f"""named AS (SELECT id, company, {norm('title')} AS name, [t FOR t IN string_split({norm('title')}, ' ') IF t <> ''] AS w FROM projects),
kinds AS (SELECT DISTINCT name, w, w[1] AS f FROM named WHERE length(w) >= 2),
alike AS (SELECT p.name, q.name AS other FROM kinds p, kinds q WHERE length(p.w) <= length(q.w) AND list_has_all(q.w, p.w) OR length(q.w) <= length(p.w) AND list_has_all(p.w, q.w)
    OR p.w[-1] = q.w[-1] AND (least(length(p.f), length(q.f)) >= 3 AND (starts_with(p.f, q.f) OR starts_with(q.f, p.f)) OR levenshtein(p.f, q.f) <= 1)),
members AS (SELECT DISTINCT id, unnest(['eight ' || id // 8, 'kind ' || id // 1000 || ' ' || type || ' ' || size]) AS container FROM projects),
meets AS (SELECT DISTINCT p.id AS a, q.id AS b FROM members p JOIN members q ON p.container = q.container AND p.id <> q.id)"""
_COLLEAGUES = "SELECT p.id AS a, q.id AS b FROM alike n JOIN named p ON p.name = n.name JOIN named q ON q.name = n.other AND p.company = q.company AND p.id < q.id"
_THROUGH = "SELECT DISTINCT p.id AS a, q.id AS b FROM meets x JOIN named p ON p.id = x.b JOIN alike n ON n.name = p.name JOIN meets y ON y.a = x.a JOIN named q ON q.id = y.b AND q.name = n.other WHERE p.id < q.id AND (p.company = q.company) IS NOT TRUE"


@query("probable_duplicate_people", sql("projects", f"{_COLLEAGUES} UNION ALL {_THROUGH}", _NAMES))
def probable_duplicate_people(spark, sf):
    """Projects stand for people; eight keys in a row meet, and those of one type and size among a thousand keys."""
    p = t.projects(spark, sf)
    people = p.select("id", T.name_norm(F.col("title")).alias("name"), T.name_tokens(F.col("title")).alias("tokens"), "company")
    eight = F.concat(F.lit("eight "), F.expr("cast(id div 8 as string)"))
    kind = F.concat_ws(" ", F.lit("kind"), F.expr("cast(id div 1000 as string)"), F.col("type"), F.col("size").cast("string"))
    members = p.select(F.explode(F.array(eight, F.when(F.col("type").isNotNull() & F.col("size").isNotNull(), kind))).alias("container"), F.col("id").alias("person"))
    return probable_duplicates(people, members)


@query("mentions_person_semi_join", sql("commitments contacts", "SELECT count(*) AS n FROM commitments WHERE counterpart IN (SELECT card FROM contacts WHERE company = 'BUILDING')"))
def mentions_person_semi_join(spark, sf):
    who = t.contacts(spark, sf).where("company = 'BUILDING'").select(F.col("card").alias("counterpart"))
    return t.commitments(spark, sf).join(who, "counterpart", "left_semi").agg(F.count("*").alias("n"))


@query("meeting_attendee_join", sql("thread_records contacts", "SELECT conv_id, count(DISTINCT sender) AS people, count(DISTINCT CASE WHEN sender LIKE 'name:%' THEN sender END) AS unmatched FROM thread_records WHERE NOT is_from_me GROUP BY conv_id"))
def meeting_attendee_join(spark, sf):
    r = t.thread_records(spark, sf).where("not is_from_me").select("conv_id", "sender").distinct()
    known = t.contacts(spark, sf).select(F.col("phone").alias("sender"), "card")
    j = r.join(known, "sender", "left")
    return j.groupBy("conv_id").agg(F.count("*").alias("people"), F.count_if(F.col("card").isNull() & F.col("sender").startswith("name:")).alias("unmatched"))


@query("turn_speaker_join", sql("thread_records", "SELECT id, CASE role WHEN 'assistant' THEN 'Owner' ELSE 'Speaker ' || turn END AS speaker FROM thread_records"))
def turn_speaker_join(spark, sf):
    names = spark.createDataFrame([("assistant", "Owner")], "role string, name string")
    return t.thread_records(spark, sf).join(F.broadcast(names), "role", "left").select("id", F.coalesce("name", F.concat(F.lit("Speaker "), F.col("turn").cast("string"))).alias("speaker"))


@query("review_source_join", sql("items projects", "SELECT i.target, count(p.id) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq, part) AS k FROM items) i LEFT JOIN projects p ON p.id = i.part WHERE k <= 5 GROUP BY i.target"))
def review_source_join(spark, sf):
    k = F.row_number().over(Window.partitionBy("target").orderBy("seq", "part"))
    first = t.items(spark, sf).withColumn("k", k).where("k <= 5")
    return first.join(t.projects(spark, sf).select(F.col("id").alias("part"), "title"), "part", "left").groupBy("target").agg(F.count("title").alias("shown"))


@query("fact_cards", sql("commitments contacts", "SELECT m.id, m.direction, c.name, c.company FROM commitments m LEFT JOIN contacts c ON c.card = m.counterpart"))
def fact_cards(spark, sf):
    c = t.contacts(spark, sf).select(F.col("card").alias("counterpart"), "name", "company")
    return t.commitments(spark, sf).join(c, "counterpart", "left").select("id", "direction", "name", "company")


@query("assemble_thread_dossiers", sql("thread_records", "SELECT thread, count(*) AS items, count(DISTINCT sender) AS people FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ts DESC, id DESC) AS k FROM thread_records) WHERE k <= 6 GROUP BY thread"))
def assemble_thread_dossiers(spark, sf):
    kept = R.newest_within_budget(t.thread_records(spark, sf), "thread", F.lit(1), 6)
    return kept.groupBy("thread").agg(F.count("*").alias("items"), F.count_distinct("sender").alias("people"))


@query("assemble_meeting_dossiers")
def assemble_meeting_dossiers(spark, sf):
    chunks = R.chunk_lines(t.thread_records(spark, sf).select("conv_id", "turn", "text"), "conv_id", "turn", 2_000, 90_000)
    return chunks.groupBy("conv_id").agg(F.max("chunk").alias("chunks"), F.sum("length").alias("chars"))


@query("batch_order", sql("projects", "SELECT id, CASE type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END AS rank FROM projects"))
def batch_order(spark, sf):
    return t.projects(spark, sf).select("id", F.when(F.col("type") == "ECONOMY", 0).when(F.col("type") == "PROMO", 1).otherwise(2).alias("rank"))


@query("purge_excluded", sql("records", "SELECT id FROM records WHERE user_id NOT IN (SELECT user_id FROM records WHERE kind = 'email' AND duration_s > 150) AND duration_s <= 200"))
def purge_excluded(spark, sf):
    judged = t.records(spark, sf).withColumn("scope", F.when((F.col("kind") == "email") & (F.col("duration_s") > 150), "thread")).withColumn("keep", F.col("scope").isNull() & (F.col("duration_s") <= 200))
    return P.purge_excluded(judged).select("id")


@query("run_ledger", sql("commitments", "SELECT CASE WHEN id % 5 = 0 THEN 'changed' ELSE 'added' END AS change, count(*) AS n FROM commitments WHERE id % 5 < 2 GROUP BY ALL"))
def run_ledger(spark, sf):
    c = t.commitments(spark, sf).where("id % 5 < 2")
    log = c.select(F.lit("run1").alias("run_id"), "id", F.when(F.col("id") % 5 == 0, F.struct("status")).alias("before"), F.struct("status").alias("after"))
    return log.groupBy(F.when(F.col("before").isNotNull(), "changed").otherwise("added").alias("change")).agg(F.count("*").alias("n"))


@query("store_meta", sql("items", "SELECT part % 100 AS key, arg_max(supplier, (date, supplier)) AS value FROM items GROUP BY ALL"))
def store_meta(spark, sf):
    rows = t.items(spark, sf).select((F.col("part") % 100).alias("key"), F.col("supplier").alias("value"), "date")
    return R.last_write(rows, "key", "value", "date").select("key", "value")


@query("notes_scan", sql("notes", "SELECT id FROM notes WHERE source = 'src3'"))
def notes_scan(spark, sf):
    return t.notes(spark, sf).where("source = 'src3'").select("id")


@query("merge_people", sql("items", "SELECT supplier AS id, arg_max(part, (date, target, seq, part)) AS topic, array_to_string(list_sort(list(DISTINCT part % 7)), ',') AS topics FROM items GROUP BY supplier"))
def merge_people(spark, sf):
    facts = t.items(spark, sf).select(F.col("supplier").alias("id"), F.col("part").alias("topic"), F.array(F.col("part") % 7).alias("topics"), "date", F.struct("target", "seq", "part").alias("seq"))
    old, new = facts.where("date < '1998-01-01'"), facts.where("date >= '1998-01-01'")
    return R.merge_contributions(old, new, "id", ["topics"]).select("id", "topic", F.array_join(F.col("topics").cast("array<string>"), ",").alias("topics"))


def _merge_by_title(name: str, threshold: float):
    @query(name, sql("projects", f"SELECT a.id AS id, min(b.id) AS into FROM x a JOIN x b ON a.company = b.company AND a.type = b.type AND b.id <= a.id WHERE {jaccard_sql('a.w', 'b.w')} >= {threshold} GROUP BY a.id", f"x AS (SELECT id, company, type, {words('title')} AS w FROM projects)").replace("AS into", "AS target"))
    def run(spark, sf):
        p = t.projects(spark, sf).select("company", "type", "id", T.content_words(F.col("title")).alias("words"))
        classed, near = similar_classes(p, threshold, ["company", "type"])
        heads = classed.groupBy(F.col("class").alias("other")).agg(F.min("id").alias("head"))
        targets = near.join(heads, "other").groupBy("class").agg(F.min("head").alias("target"))
        return classed.join(targets, "class").groupBy("id").agg(F.min("target").alias("target"))



for _name, _threshold in (("merge_decisions", 0.6), ("merge_ideas", 0.7), ("merge_knowledge", 0.7), ("merge_opportunities", 0.5)):
    _merge_by_title(_name, _threshold)


@query("merge_meetings", sql("thread_records", "SELECT 'm_' || left(sha1('conv:' || conv_id), 10) AS id, count(*) AS points FROM thread_records GROUP BY conv_id"))
def merge_meetings(spark, sf):
    return t.thread_records(spark, sf).groupBy(F.concat(F.lit("m_"), F.left(F.sha1("thread"), F.lit(10))).alias("id")).agg(F.count("*").alias("points"))


@query("merge_review", sql("projects", "SELECT 'r_' || left(sha1(title), 10) AS id, count(*) AS asked FROM projects GROUP BY title"))
def merge_review(spark, sf):
    return t.projects(spark, sf).groupBy(F.concat(F.lit("r_"), F.left(F.sha1("title"), F.lit(10))).alias("id")).agg(F.count("*").alias("asked"))


@query("apply_identity_fixes", sql("contacts", "SELECT card, CASE WHEN card % 10 = 1 THEN 'Renamed ' || card ELSE name END AS name FROM contacts"))
def apply_identity_fixes(spark, sf):
    c = t.contacts(spark, sf).select("card", "name")
    fixes = c.where("card % 10 = 1").select("card", F.concat(F.lit("Renamed "), F.col("card").cast("string")).alias("fix"), F.lit(1).alias("at"))
    last = fixes.groupBy("card").agg(F.max_by("fix", "at").alias("fix"))
    return c.join(last, "card", "left").select("card", F.coalesce("fix", "name").alias("name"))


@query("resolve_review", sql("commitments", "SELECT id, CASE WHEN id % 3 = 0 THEN 'resolved' ELSE status END AS status FROM commitments"))
def resolve_review(spark, sf):
    c = t.commitments(spark, sf).select("id", "status")
    answers = c.where("id % 3 = 0").select("id", F.lit("resolved").alias("answer"))
    return c.join(answers, "id", "left").select("id", F.coalesce("answer", "status").alias("status"))


@query("person_title", sql("contacts", "SELECT card, CASE WHEN card % 2 = 0 THEN name ELSE 'Ann Maria Lee' END AS title FROM contacts"))
def person_title(spark, sf):
    other = F.lit("Ann Maria Lee")
    longer = F.when(F.size(T.name_tokens(other)) > F.size(T.name_tokens(F.lit("Ann Lee"))), other).otherwise("Ann Lee")
    return t.contacts(spark, sf).select("card", F.when(F.col("card") % 2 == 0, F.col("name")).otherwise(longer).alias("title"))


@query("late_data", sql("records", "SELECT ts < TIMESTAMP '2024-01-10' AS late, count(*) AS n FROM records GROUP BY ALL"))
def late_data(spark, sf):
    return t.records(spark, sf).groupBy((F.col("ts") < F.lit("2024-01-10").cast("timestamp")).alias("late")).agg(F.count("*").alias("n"))


@query("retry_pending", sql("thread_records", "SELECT DISTINCT conv_id FROM thread_records WHERE conv_id NOT IN (SELECT conv_id FROM thread_records WHERE turn >= 5)"))
def retry_pending(spark, sf):
    r = t.thread_records(spark, sf)
    return r.select("conv_id").distinct().join(r.where("turn >= 5").select("conv_id").distinct(), "conv_id", "left_anti")


@query("default_scope", sql("commitments", "SELECT CASE WHEN count(*) FILTER (status = 'open') > 0 THEN 'install' ELSE 'update' END AS scope FROM commitments"))
def default_scope(spark, sf):
    return t.commitments(spark, sf).agg(F.when(F.count_if(F.col("status") == "open") > 0, "install").otherwise("update").alias("scope"))


@query("view_formula", sql("commitments", f"SELECT id, CAST(date_diff('day', {_TODAY}, due) AS BIGINT) AS days_left FROM commitments"))
def view_formula(spark, sf):
    return t.commitments(spark, sf).select("id", F.expr(f"cast(datediff(due, date'{t.ORDERS_NOW}') as bigint)").alias("days_left"))


@query("account_addresses", sql("thread_records", "SELECT role, count(DISTINCT sender) AS addresses FROM thread_records GROUP BY role"))
def account_addresses(spark, sf):
    return t.thread_records(spark, sf).groupBy("role").agg(F.count_distinct("sender").alias("addresses"))


@query("map_chat_messages", sql("thread_records", "SELECT thread, count(*) AS n FROM thread_records WHERE turn < 6 AND text <> '' GROUP BY thread"))
def map_chat_messages(spark, sf):
    """Messages joined to their chats and members; reactions and empty rows are left out."""
    r = t.thread_records(spark, sf).withColumn("reaction", F.when(F.col("turn") >= 6, 2000).otherwise(0))
    chats = r.groupBy("thread").agg(F.collect_set("sender").alias("members"))
    return r.where("reaction < 1000 and text <> ''").join(chats, "thread").groupBy("thread").agg(F.count("*").alias("n"))


@query("map_mail_index", sql("records", "SELECT sha1(other) AS thread, count(*) AS n FROM records WHERE kind = 'email' GROUP BY other"))
def map_mail_index(spark, sf):
    m = t.records(spark, sf).where("kind = 'email'")
    people = F.array_sort(F.array_distinct(F.array("other")))
    return m.groupBy(F.sha1(F.array_join(people, ",")).alias("thread")).agg(F.count("*").alias("n"))
