"""Queries over identity, aggregation and joins, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.operators import identity as I
from threadloom.operators import records as R
from threadloom.operators.pairs import all_partners, near_duplicate_bullets, similar_classes, similar_pairs
from threadloom.plans import tables as t
from threadloom.plans.q_scalar import jaccard_sql, words
from threadloom.plans.tables import sql
from threadloom.storage import materialize

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


_NOW = "TIMESTAMP '2024-02-01'"


def now():
    return F.lit(t.NOW).cast("timestamp")


_STATS = f"""stats AS (SELECT other AS handle, count(*) FILTER (kind IN ('message', 'email') AND NOT is_from_me) AS inbound, count(*) FILTER (kind IN ('message', 'email') AND is_from_me) AS outbound,
    count(*) FILTER (kind = 'meeting') AS meetings, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'call' AND duration_s > 0) AS answered, count(*) FILTER (kind = 'email' AND NOT is_from_me) AS emails,
    count(DISTINCT CASE WHEN ts >= {_NOW} - INTERVAL 365 DAY THEN CAST(ts AS DATE) END) AS days, min(ts) AS first_seen, max(ts) AS last_seen FROM records GROUP BY other)"""
_STRONG = f"""strong AS (SELECT *, (inbound > 0 AND outbound > 0) OR meetings > 0 OR answered > 0 AS two_way, CAST(date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-01') AS BIGINT) AS ago FROM stats),
people AS (SELECT handle, two_way, last_seen, inbound, outbound, meetings, calls, answered, days, CAST(round(100 * (0.45 * least(1.0, ln(1 + days) / ln(121.0)) + 0.35 * exp(-ago / 90.0) + 0.2 * CAST(two_way AS INTEGER))) AS INTEGER) AS strength FROM strong),
ranked AS (SELECT *, row_number() OVER (ORDER BY strength DESC, handle) AS place FROM people),
tiers AS (SELECT *, CASE WHEN strength >= 75 AND place <= 30 THEN 'inner' WHEN strength >= 50 THEN 'active' WHEN strength >= 25 THEN 'network' ELSE 'cold' END AS tier FROM ranked)"""


def stats(spark, sf):
    return I.handle_stats(t.records(spark, sf), now())


def people(spark, sf):
    s = stats(spark, sf).withColumn("two_way", I.two_way(None))
    ago = F.datediff(now(), "last_seen")
    return I.tier_rank(s.withColumn("strength", I.relationship_strength(F.col("days"), ago, F.col("two_way"))))


@query("handle_stats", sql("records", "SELECT handle, inbound, outbound, meetings, calls, answered, emails, days, epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us FROM stats", _STATS))
def handle_stats(spark, sf):
    return stats(spark, sf).select("handle", "inbound", "outbound", "meetings", "calls", "answered", "emails", "days", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query("relationship_strength", sql("records", "SELECT handle, two_way, strength FROM people", _STATS + ",\n" + _STRONG))
def relationship_strength(spark, sf):
    return people(spark, sf).select("handle", "two_way", "strength")


@query("tier_rank", sql("records", "SELECT handle, strength, tier FROM tiers", _STATS + ",\n" + _STRONG))
def tier_rank(spark, sf):
    return people(spark, sf).select("handle", "strength", "tier")


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ts DESC, id) AS r FROM records) WHERE r = 1)"
_RANK = "CASE tier WHEN 'inner' THEN 0 WHEN 'active' THEN 1 WHEN 'network' THEN 2 ELSE 3 END"


@query("people_waiting", sql("records", f"SELECT l.thread, l.other AS handle, p.tier, epoch_us(l.ts) AS ts_us FROM latest l JOIN tiers p ON l.other = p.handle WHERE NOT l.is_from_me AND l.ts < {_NOW} - INTERVAL 20 HOUR ORDER BY {_RANK}, l.ts, l.thread LIMIT 10", ",\n".join([_STATS, _STRONG, _LATEST])))
def people_waiting(spark, sf):
    """Threads whose newest record came in and has waited twenty hours; by tier, then longest; the first ten."""
    last = R.latest_per(t.records(spark, sf), "thread").where(~F.col("is_from_me") & (F.col("ts") < now() - F.expr("INTERVAL 20 HOURS")))
    joined = last.join(people(spark, sf).select(F.col("handle").alias("other"), "tier"), "other")
    rank = F.when(F.col("tier") == "inner", 0).when(F.col("tier") == "active", 1).when(F.col("tier") == "network", 2).otherwise(3)
    return joined.orderBy(rank, "ts", "thread").limit(10).select("thread", F.col("other").alias("handle"), "tier", F.unix_micros("ts").alias("ts_us"))


@query("latest_per_thread", sql("records", "SELECT thread, id, epoch_us(ts) AS ts_us FROM latest", _LATEST))
def latest_per_thread(spark, sf):
    return R.latest_per(t.records(spark, sf), "thread").select("thread", "id", F.unix_micros("ts").alias("ts_us"))


@query("latest_per_handle", sql("records", "SELECT other AS handle, arg_max(id, (ts, id)) AS id FROM records GROUP BY other"))
def latest_per_handle(spark, sf):
    return t.records(spark, sf).groupBy(F.col("other").alias("handle")).agg(F.max_by("id", F.struct("ts", "id")).alias("id"))


@query("counts_by_source_kind", sql("records thread_records notes", "SELECT source, kind, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM (SELECT source, kind, ts FROM records UNION ALL SELECT source, kind, ts FROM thread_records UNION ALL SELECT source, kind, ts FROM notes) GROUP BY ALL"))
def counts_by_source_kind(spark, sf):
    cols = ["source", "kind", "ts"]
    every = t.records(spark, sf).select(*cols).unionByName(t.thread_records(spark, sf).select(*cols)).unionByName(t.notes(spark, sf).select(*cols))
    return every.groupBy("source", "kind").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("union_sources", sql("records thread_records notes", "SELECT id, source FROM records UNION ALL SELECT id, source FROM thread_records UNION ALL SELECT id, source FROM notes"))
def union_sources(spark, sf):
    return t.records(spark, sf).unionByName(t.thread_records(spark, sf), allowMissingColumns=True).unionByName(t.notes(spark, sf), allowMissingColumns=True).select("id", "source")


@query("thread_stats", sql("thread_records", "SELECT thread, count(*) AS messages, count(DISTINCT sender) AS senders, count(*) FILTER (is_from_me) AS own, epoch_us(max(ts)) AS last_us FROM thread_records GROUP BY thread"))
def thread_stats(spark, sf):
    return t.thread_records(spark, sf).groupBy("thread").agg(F.count("*").alias("messages"), F.count_distinct("sender").alias("senders"), F.count_if("is_from_me").alias("own"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("owner_inference", sql("thread_records", "SELECT sender AS handle, count(*) FILTER (is_from_me) AS from_me, count(*) FILTER (NOT is_from_me) AS from_other FROM thread_records GROUP BY sender HAVING from_me > 0 AND from_me > from_other"))
def owner_inference(spark, sf):
    return I.owner_inference(t.thread_records(spark, sf).select(F.col("sender").alias("handle"), "is_from_me"))


@query("shared_handle_filter", sql("offices", "SELECT handle, count(DISTINCT card) AS cards FROM offices GROUP BY handle HAVING cards > 2"))
def shared_handle_filter(spark, sf):
    return I.shared_handles(t.offices(spark, sf))


def _cards(spark, sf):
    c = t.contacts(spark, sf).select(F.concat(F.lit("c:"), F.col("card").cast("string")).alias("card"), F.explode(F.array("phone", "mail")).alias("handle"))
    return c.unionByName(t.offices(spark, sf))


_CARDS = """cards AS (SELECT 'c:' || card AS card, unnest([phone, mail]) AS handle FROM contacts UNION ALL SELECT card, handle FROM offices),
usable AS (SELECT * FROM cards WHERE handle IN (SELECT handle FROM cards GROUP BY handle HAVING count(DISTINCT card) <= 2)),
nodes AS (SELECT DISTINCT handle FROM (SELECT other AS handle FROM records UNION ALL SELECT handle FROM usable)),
edges AS (SELECT a.handle AS x, b.handle AS y FROM usable a JOIN usable b ON a.card = b.card UNION SELECT a.handle, b.handle FROM nodes a JOIN nodes b ON right(a.handle, 10) = right(b.handle, 10) AND a.handle LIKE 'tel:%' AND b.handle LIKE 'tel:%')"""


@query("connected_identities", sql("records contacts offices", "SELECT x AS handle, min(y) AS root FROM reach GROUP BY x", _CARDS + ",\nreach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)").replace("WITH records", "WITH RECURSIVE records"))
def connected_identities(spark, sf):
    owners = spark.createDataFrame([(t.OWNER,)], "handle string")
    edges = I.identity_edges(_cards(spark, sf), t.records(spark, sf).select(F.col("other").alias("handle")).distinct(), owners)
    own = edges.select(F.col("src").alias("handle")).distinct()
    found = I.connected_identities(edges)
    return own.join(found, "handle", "left").select("handle", F.coalesce("root", "handle").alias("root"))


@query("person_rollup")
def person_rollup(spark, sf):
    clusters = connected_identities(spark, sf)
    return I.person_rollup(stats(spark, sf), clusters).select(I.person_id(F.col("root")).alias("person_id"), "root", "inbound", "outbound", "meetings", "calls", "handles")


@query("stable_ids")
def stable_ids(spark, sf):
    clusters = materialize(connected_identities(spark, sf), "clusters")
    prior = clusters.where(F.crc32(F.col("handle")) % 3 != 0).select("handle", F.concat(F.lit("p_old"), F.crc32(F.col("root")).cast("string")).alias("person_id"))
    return I.stable_ids(clusters, prior)


@query("top_name", sql("records contacts", "SELECT other, name, n FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY n DESC, length(name) DESC, name) AS r FROM (SELECT r.other, c.company AS name, count(*) AS n FROM records r JOIN contacts c ON r.duration_s = c.card GROUP BY ALL)) WHERE r = 1"))
def top_name(spark, sf):
    names = t.records(spark, sf).join(t.contacts(spark, sf), F.col("duration_s") == F.col("card")).select("other", F.col("company").alias("name"))
    return I.top_name(names, "other")


@query("person_aliases", sql("records contacts", "SELECT other, array_to_string(list(name ORDER BY r), ',') AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY n DESC, name) AS r FROM (SELECT r.other, c.company AS name, count(*) AS n FROM records r JOIN contacts c ON r.duration_s = c.card GROUP BY ALL)) WHERE r BETWEEN 2 AND 6 GROUP BY other"))
def person_aliases(spark, sf):
    names = t.records(spark, sf).join(t.contacts(spark, sf), F.col("duration_s") == F.col("card")).select("other", F.col("company").alias("name"))
    return I.person_aliases(names, "other").select("other", F.array_join("aliases", ",").alias("aliases"))


@query("company_hint", sql("records", "SELECT handle, split_part(handle, '@', 2) AS domain, inbound + 1 AS weight FROM stats WHERE handle LIKE 'mailto:%' AND split_part(handle, '@', 2) <> 'example.com'", _STATS))
def company_hint(spark, sf):
    s = stats(spark, sf).withColumn("who", F.col("handle"))
    return I.company_hint(s, "who", "example.com").select(F.col("who").alias("handle"), "domain", "weight")


@query("classify_person_kind", sql("records", "SELECT handle, CASE WHEN calls > 0 AND answered = 0 AND inbound + outbound + meetings = 0 THEN 'system' WHEN outbound = 0 AND meetings = 0 AND answered = 0 AND inbound >= 10 AND inbound = emails THEN 'system' ELSE 'person' END AS kind FROM stats", _STATS))
def classify_person_kind(spark, sf):
    s = stats(spark, sf).withColumns({"automated": H.is_short_code(F.col("handle")) | H.is_automated(F.col("handle")), "has_card": F.lit(False)})
    return s.select("handle", I.person_kind().alias("kind"))


@query("identity_stats", sql("records", "SELECT tier, count(*) AS people FROM tiers GROUP BY tier", _STATS + ",\n" + _STRONG))
def identity_stats(spark, sf):
    return people(spark, sf).groupBy("tier").agg(F.count("*").alias("people"))


@query("group_chats", sql("thread_records", "SELECT thread, array_to_string(list_sort(list(DISTINCT sender)), ',') AS members, count(*) AS messages FROM thread_records WHERE NOT is_from_me GROUP BY thread HAVING count(DISTINCT sender) >= 2"))
def group_chats(spark, sf):
    other = t.thread_records(spark, sf).where(~F.col("is_from_me")).select("thread", F.col("sender").alias("party"), "ts")
    return I.group_chats(other).select("thread", F.array_join("members", ",").alias("members"), "messages")


@query("two_way_contact", sql("records", "SELECT handle, two_way FROM people", _STATS + ",\n" + _STRONG))
def two_way_contact(spark, sf):
    return people(spark, sf).select("handle", "two_way")


@query("same_name_pairs")
def same_name_pairs(spark, sf):
    p = t.projects(spark, sf).select("id", F.col("title").alias("name"), F.col("size").alias("strength"))
    return I.same_name_pairs(p)


@query("contact_name_join", sql("records contacts", "SELECT r.id, c.name FROM records r LEFT JOIN contacts c ON r.other = c.phone OR r.other = c.mail"))
def contact_name_join(spark, sf):
    names = t.contacts(spark, sf).select(F.explode(F.array(F.coalesce(H.last10(F.col("phone")), "phone"), "mail")).alias("key"), "name")
    return t.records(spark, sf).withColumn("key", F.coalesce(H.last10(F.col("other")), "other")).join(names, "key", "left").select("id", "name")


@query("handle_to_person_join", sql("records contacts", "SELECT r.other AS handle, max(c.card) AS card, count(*) AS n FROM records r JOIN contacts c ON r.other = c.mail OR right(r.other, 10) = right(c.phone, 10) GROUP BY r.other"))
def handle_to_person_join(spark, sf):
    c = t.contacts(spark, sf)
    exact = c.select(F.explode(F.array("phone", "mail")).alias("other"), F.col("card").alias("exact"))
    tail = c.select(H.last10(F.col("phone")).alias("tail"), F.col("card").alias("by_tail"))
    r = t.records(spark, sf).withColumn("tail", H.last10(F.col("other"))).join(exact, "other", "left").join(tail, "tail", "left")
    return r.withColumn("card", F.coalesce("exact", "by_tail")).where("card is not null").groupBy(F.col("other").alias("handle")).agg(F.max("card").alias("card"), F.count("*").alias("n"))


@query("unique_name_join", sql("projects", "SELECT title, min(id) AS id FROM projects WHERE title LIKE '% %' GROUP BY title HAVING count(*) = 1"))
def unique_name_join(spark, sf):
    p = t.projects(spark, sf).where(F.size(T.name_tokens(F.col("title"))) >= 2)
    return p.groupBy("title").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("title", "id")


@query("nearest_call_join", sql("records", "SELECT id, rid, gap FROM (SELECT a.id, b.id AS rid, abs(a.s - b.s) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.s - b.s), b.id) AS r FROM (SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records WHERE kind = 'meeting') a JOIN (SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records WHERE kind = 'call') b ON abs(a.s - b.s) <= 180) WHERE r = 1"))
def nearest_call_join(spark, sf):
    r = t.records(spark, sf).withColumn("at", F.unix_seconds("ts"))
    return R.nearest_within(r.where("kind = 'meeting'").select("id", "at"), r.where("kind = 'call'").select(F.col("id").alias("rid"), F.col("at").alias("rat")))


@query("thread_context_join", sql("records", "SELECT r.id FROM (SELECT r.id, row_number() OVER (PARTITION BY r.thread ORDER BY r.ts DESC, r.id DESC) AS k FROM records r JOIN (SELECT thread, min(ts) AS first FROM records WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY thread) f ON r.thread = f.thread AND r.ts < f.first) r WHERE k <= 4"))
def thread_context_join(spark, sf):
    r = t.records(spark, sf)
    first = r.where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")).groupBy("thread").agg(F.min("ts").alias("first"))
    before = r.join(first, "thread").where("ts < first")
    return before.withColumn("k", F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("ts"), F.desc("id")))).where("k <= 4").select("id")


@query("thread_first_changed", sql("records", "SELECT thread, epoch_us(min(ts)) AS first_us FROM records WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY thread"))
def thread_first_changed(spark, sf):
    return t.records(spark, sf).where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")).groupBy("thread").agg(F.unix_micros(F.min("ts")).alias("first_us"))


@query("counterpart_join", sql("thread_records", "SELECT thread, arg_max(sender, (ts, id)) AS counterpart FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ts DESC, id DESC) AS k FROM thread_records) WHERE k <= 40 AND sender LIKE 'name:%' GROUP BY thread"))
def counterpart_join(spark, sf):
    by = Window.partitionBy("thread").orderBy(F.desc("ts"), F.desc("id"))
    last = t.thread_records(spark, sf).withColumn("k", F.row_number().over(by)).where((F.col("k") <= 40) & F.col("sender").startswith("name:"))
    return last.groupBy("thread").agg(F.max_by("sender", F.struct("ts", "id")).alias("counterpart"))


_BULLETS = f"""x AS (SELECT i.target * 10 + i.seq AS k, i.target, i.date, i.part, list_sort({words('p.title')}) AS w FROM items i JOIN projects p ON i.part = p.id),
heads AS (SELECT *, min(k) OVER (PARTITION BY target, date, part, w) AS head FROM x)"""
_SIMILAR = jaccard_sql("a.w", "b.w")


@query("near_duplicate_bullet_join", sql("items projects", f"SELECT head AS a, k AS b, 1.0 AS score FROM heads WHERE head <> k UNION ALL SELECT a.k, b.k, round({_SIMILAR}, 6) FROM heads a JOIN heads b ON a.target = b.target AND a.date = b.date AND a.part = b.part AND a.k < b.k WHERE a.k = a.head AND b.k = b.head AND {_SIMILAR} >= 0.6", _BULLETS))
def near_duplicate_bullet_join(spark, sf):
    titles = t.projects(spark, sf).select(F.col("id").alias("part"), T.content_words(F.col("title")).alias("words"))
    bullets = t.items(spark, sf).select((F.col("target") * 10 + F.col("seq")).alias("id"), "target", "date", F.array("ref").alias("refs"), "part")
    return near_duplicate_bullets(bullets, worded=lambda left: left.join(titles, "part")).withColumn("score", F.round("score", 6))


@query("similar_fact_join", sql("projects", f"SELECT a.id AS id, arg_max(b.id, ({jaccard_sql('a.w', 'b.w')}, -b.id)) AS best FROM x a JOIN x b ON a.company = b.company AND a.type = b.type AND a.id <> b.id WHERE {jaccard_sql('a.w', 'b.w')} >= 0.5 GROUP BY a.id", f"x AS (SELECT id, company, type, {words('title')} AS w FROM projects)"))
def similar_fact_join(spark, sf):
    p = t.projects(spark, sf).select("company", "type", "id", T.content_words(F.col("title")).alias("words"))
    classed, near = similar_classes(p, 0.5, ["company", "type"])
    heads = classed.groupBy("class").agg(F.min("id").alias("o"))
    second = classed.join(heads, "class").where("id <> o").groupBy("class").agg(F.min("id").alias("o"))
    # a class names its smallest id, and its second for the row that is its smallest; copies beat all others
    shown = near.join(heads.unionByName(second).withColumnRenamed("class", "other"), "other").groupBy("class", "o").agg(F.max("score").alias("score"))
    first = Window.partitionBy("class").orderBy(F.desc("score"), "o")
    two = shown.withColumn("_r", F.row_number().over(first)).where("_r <= 2").select("class", "o", "score")
    both = classed.select("id", "class").join(two, "class").where("id <> o")
    return both.groupBy("id").agg(F.max_by("o", F.struct("score", -F.col("o"))).alias("best"))


@query("source_ref_semi_join", sql("items projects", "SELECT count(*) AS n FROM items WHERE part IN (SELECT id FROM projects WHERE size > 25)"))
def source_ref_semi_join(spark, sf):
    return t.items(spark, sf).join(t.projects(spark, sf).where("size > 25").select(F.col("id").alias("part")), "part", "left_semi").agg(F.count("*").alias("n"))


@query("open_loops_join", sql("commitments contacts", "SELECT c.card, count(*) AS open_loops, strftime(min(m.due), '%Y-%m-%d') AS next_due FROM commitments m JOIN contacts c ON m.counterpart = c.card WHERE m.status = 'open' GROUP BY c.card"))
def open_loops_join(spark, sf):
    m = t.commitments(spark, sf).where("status = 'open'").join(t.contacts(spark, sf), F.col("counterpart") == F.col("card"))
    return m.groupBy("card").agg(F.count("*").alias("open_loops"), F.min("due").cast("string").alias("next_due"))


@query("company_rollup_join", sql("contacts commitments", "SELECT company, count(DISTINCT card) AS people, count(m.id) AS open_loops FROM contacts c LEFT JOIN (SELECT * FROM commitments WHERE status = 'open') m ON m.counterpart = c.card GROUP BY company"))
def company_rollup_join(spark, sf):
    loops = t.commitments(spark, sf).where("status = 'open'").groupBy(F.col("counterpart").alias("card")).agg(F.count("*").alias("n"))
    return t.contacts(spark, sf).join(loops, "card", "left").groupBy("company").agg(F.count_distinct("card").alias("people"), F.sum(F.coalesce("n", F.lit(0))).alias("open_loops"))


@query("project_rollup_join", sql("projects items", "SELECT p.company, count(*) AS bullets, strftime(max(i.date), '%Y-%m-%d') AS last FROM projects p JOIN items i ON i.part = p.id GROUP BY p.company"))
def project_rollup_join(spark, sf):
    per = t.items(spark, sf).groupBy("part").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    return t.projects(spark, sf).join(per, F.col("id") == F.col("part")).groupBy("company").agg(F.sum("n").alias("bullets"), F.max("last").cast("string").alias("last"))


@query("backfill_link_join", sql("commitments contacts", "SELECT m.id, coalesce(CASE WHEN m.id % 2 = 0 THEN m.counterpart END, c.card) AS person FROM commitments m LEFT JOIN contacts c ON c.card = m.counterpart"))
def backfill_link_join(spark, sf):
    known = F.when(F.col("id") % 2 == 0, F.col("counterpart"))
    m = t.commitments(spark, sf).withColumn("known", known)
    return m.join(t.contacts(spark, sf).select(F.col("card").alias("counterpart"), F.col("card").alias("found")), "counterpart", "left").select("id", F.coalesce("known", "found").alias("person"))


@query("name_alias_join", sql("projects", "SELECT a.id, count(*) AS hits, min(b.id) AS first FROM projects a JOIN projects b ON a.title = b.title GROUP BY a.id"))
def name_alias_join(spark, sf):
    p = t.projects(spark, sf).withColumn("key", T.name_norm(F.col("title")))
    per = p.groupBy("key").agg(F.count("*").alias("hits"), F.min("id").alias("first"))
    return p.join(per, "key").select("id", "hits", "first")


@query("probable_duplicate_projects", sql("projects", f"SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.company = b.company AND a.id < b.id WHERE {jaccard_sql('a.w', 'b.w')} >= 0.6", f"x AS (SELECT id, company, {words('title')} AS w FROM projects)"))
def probable_duplicate_projects(spark, sf):
    p = t.projects(spark, sf).select("company", "id", T.content_words(F.col("title")).alias("words"))
    return similar_pairs(p, 0.6, ["company"])


@query(
    "probable_duplicate_companies",
    "WITH x AS (SELECT s_suppkey AS id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM supplier UNION ALL SELECT 1000000 + n_nationkey, trim(lower(n_name)) FROM nation UNION ALL SELECT 2000000 + n_nationkey, trim(lower(n_name)) || ' group' FROM nation) "
    "SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.id < b.id AND a.k <> b.k AND least(length(a.k), length(b.k)) >= 4 AND (levenshtein(a.k, b.k) <= 1 OR starts_with(a.k, b.k || ' ') OR starts_with(b.k, a.k || ' '))",
)
def probable_duplicate_companies(spark, sf):
    """Keys at an edit distance of one share a string of one letter less, or are one; a bucket of such a string holds some hundreds of keys at most. Names that begin another's words meet on those."""
    nation = t.read(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    names = t.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    names = names.unionByName(nation.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("id"), "name")).unionByName(nation.select((F.col("n_nationkey") + 2_000_000).cast("long").alias("id"), F.concat("name", F.lit(" group")).alias("name")))
    keyed = names.select("id", T.company_key(F.col("name")).alias("key")).where(F.length("key") >= 4)
    keys = keyed.select("key").distinct()
    without = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(F.left("key", i - 1), F.substr("key", i + 1)))
    near = keys.select("key", F.explode(F.array_distinct(F.concat(F.array("key"), without))).alias("meet"))
    a, b = near.select("meet", F.col("key").alias("x")), near.select("meet", F.col("key").alias("y"))
    pairs = a.join(b, "meet").where((F.col("x") < F.col("y")) & (F.levenshtein("x", "y") <= 1)).select("x", "y")
    words = F.split("key", " ")
    heads = keys.where(F.size(words) > 1).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("head"))
    begun = heads.join(keys.select(F.col("key").alias("head")), "head").select(F.least("head", "key").alias("x"), F.greatest("head", "key").alias("y"))
    pairs = pairs.unionByName(begun).distinct()
    full = pairs.join(keyed.select(F.col("key").alias("x"), F.col("id").alias("i")), "x").join(keyed.select(F.col("key").alias("y"), F.col("id").alias("j")), "y")
    return full.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


_MET = """m AS (SELECT DISTINCT target, supplier FROM items), met AS (SELECT a.supplier AS a, b.supplier AS b, count(*) AS shared FROM m a JOIN m b ON a.target = b.target AND a.supplier <> b.supplier GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM met)"""


@query("co_participation_pairs", sql("items", "SELECT a, b, shared, rank FROM ranked", _MET))
def co_participation_pairs(spark, sf):
    """All whom each supplier meets in orders, ranked by how often."""
    return all_partners(t.items(spark, sf).select(F.col("target").alias("container"), F.col("supplier").alias("person")))


@query("maybe_done_join", sql("commitments items", "SELECT m.id, count(*) AS evidence FROM (SELECT m.id, row_number() OVER (PARTITION BY m.id ORDER BY i.date, i.seq) AS k FROM commitments m JOIN items i ON i.target = m.id AND i.date > m.date WHERE m.status = 'open') m WHERE k <= 3 GROUP BY m.id"))
def maybe_done_join(spark, sf):
    later = t.commitments(spark, sf).where("status = 'open'").select(F.col("id").alias("target"), F.col("date").alias("since")).join(t.items(spark, sf), "target").where("date > since")
    k = F.row_number().over(Window.partitionBy("target").orderBy("date", "seq"))
    return later.withColumn("k", k).where("k <= 3").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("evidence"))


@query("recap_anti_join", sql("records thread_records", "SELECT r.id FROM records r WHERE r.kind = 'meeting' AND NOT EXISTS (SELECT 1 FROM records o WHERE o.kind = 'call' AND o.thread = r.thread AND CAST(o.ts AS DATE) = CAST(r.ts AS DATE))"))
def recap_anti_join(spark, sf):
    r = t.records(spark, sf).withColumn("day", F.to_date("ts"))
    return r.where("kind = 'meeting'").join(r.where("kind = 'call'").select("thread", "day"), ["thread", "day"], "left_anti").select("id")


@query("export_native_anti_join", sql("thread_records", "SELECT id FROM thread_records WHERE conv_id % 2 = 0"))
def export_native_anti_join(spark, sf):
    r = t.thread_records(spark, sf).withColumns({"minute": F.date_trunc("minute", F.col("ts")), "folded": T.fold_accents(F.lower("text"))})
    return r.join(r.where("conv_id % 2 = 1").select("thread", "minute", "folded"), ["thread", "minute", "folded"], "left_anti").select("id")


@query("group_membership_join", sql("thread_records", "SELECT thread, sender AS member FROM thread_records WHERE NOT is_from_me GROUP BY ALL"))
def group_membership_join(spark, sf):
    return t.thread_records(spark, sf).where(~F.col("is_from_me")).select("thread", F.col("sender").alias("member")).distinct()


@query("person_card", sql("records contacts commitments", "SELECT c.card, c.name, c.phone, c.mail, p.tier, coalesce(o.n, 0) AS open_loops FROM contacts c JOIN tiers p ON p.handle IN (c.phone, c.mail) LEFT JOIN (SELECT counterpart, count(*) AS n FROM commitments WHERE status = 'open' GROUP BY 1) o ON o.counterpart = c.card", _STATS + ",\n" + _STRONG))
def person_card(spark, sf):
    c = t.contacts(spark, sf)
    by = c.select(F.explode(F.array("phone", "mail")).alias("handle"), "card")
    loops = t.commitments(spark, sf).where("status = 'open'").groupBy(F.col("counterpart").alias("card")).agg(F.count("*").alias("n"))
    tier = people(spark, sf).select("handle", "tier").join(by, "handle").select("card", "tier")
    return c.join(tier, "card").join(loops, "card", "left").select("card", "name", "phone", "mail", "tier", F.coalesce("n", F.lit(0)).alias("open_loops"))


@query("ref_to_meeting_join", sql("items projects", "SELECT p.type, count(*) AS refs FROM items i JOIN projects p ON i.ref = 'part:' || p.id GROUP BY p.type"))
def ref_to_meeting_join(spark, sf):
    p = t.projects(spark, sf).select(F.concat(F.lit("part:"), F.col("id").cast("string")).alias("ref"), "type")
    return t.items(spark, sf).join(p, "ref").groupBy("type").agg(F.count("*").alias("refs"))


@query("owner_name_join", sql("thread_records", "SELECT role IN ('assistant') AS owner, count(*) AS n FROM thread_records GROUP BY ALL"))
def owner_name_join(spark, sf):
    name = F.when(F.col("role") == "assistant", F.lit("The Assistant")).otherwise(F.col("role"))
    return t.thread_records(spark, sf).groupBy(T.name_norm(name).isin("the assistant", "me", "i", "yo").alias("owner")).agg(F.count("*").alias("n"))


@query("broken_link_anti_join", sql("items projects", "SELECT i.target, i.seq FROM items i WHERE i.part NOT IN (SELECT id FROM projects WHERE size < 40)"))
def broken_link_anti_join(spark, sf):
    return t.items(spark, sf).join(t.projects(spark, sf).where("size < 40").select(F.col("id").alias("part")), "part", "left_anti").select("target", "seq")
