"""Queries over scalar functions and filters, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import dates as D
from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.operators import privacy as P
from threadloom.operators.pairs import TASKS, scored_pairs
from threadloom.plans import tables as t
from threadloom.plans.tables import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


_FOLD = "translate(lower({x}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_NORM = "trim(regexp_replace(regexp_replace(" + _FOLD + ", '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g'), ' +', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
_WORDS = "list_distinct(list_filter(string_split(" + _NORM + ", ' '), lambda w: length(w) > 2 AND NOT list_contains(" + _STOP + ", w)))"


def norm(x: str) -> str:
    return _NORM.format(x=x)


def words(x: str) -> str:
    return _WORDS.format(x=x)


def jaccard_sql(a: str, b: str) -> str:
    common = f"length(list_intersect({a}, {b}))"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE {common}::DOUBLE / (length({a}) + length({b}) - {common}) END"


@query("norm_phone", sql("contacts", "SELECT card, '+' || substr(phone, 6) AS norm, right(phone, 10) AS tail FROM contacts"))
def norm_phone(spark, sf):
    raw = F.regexp_replace(H.value(F.col("phone")), r"^\+1(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    return t.contacts(spark, sf).select("card", H.norm_phone(raw).alias("norm"), H.last10(H.phone_handle(raw)).alias("tail"))


@query("norm_email", sql("contacts", "SELECT card, substr(mail, 8) AS norm, split_part(mail, '@', 2) AS domain FROM contacts"))
def norm_email(spark, sf):
    raw = F.concat("name", F.lit(" <"), F.upper(H.value(F.col("mail"))), F.lit(">"))
    # read from few files, so the cards are dealt out; the address is looked for once
    found = t.contacts(spark, sf).repartition(TASKS).select("card", H.norm_email(raw).alias("norm"))
    return found.select("card", "norm", H.email_domain(F.concat(F.lit("mailto:"), "norm")).alias("domain"))


@query("make_handle", sql("contacts", "SELECT card, mail AS by_mail, phone AS by_phone, 'name:' || lower(company) AS by_name, 'slack:T1/' || card AS by_slack, 'group:chat:' || card AS by_group FROM contacts"))
def make_handle(spark, sf):
    c = t.contacts(spark, sf)
    key = F.col("card").cast("string")
    return c.select("card", H.make_handle(H.value(F.col("mail"))).alias("by_mail"), H.make_handle(H.value(F.col("phone"))).alias("by_phone"), H.make_handle(F.col("company")).alias("by_name"), H.slack_handle(F.lit("T1"), key).alias("by_slack"), H.group_handle(F.lit("chat"), key).alias("by_group"))


@query("parse_handle", sql("records", "SELECT other, split_part(other, ':', 1) AS scheme, substr(other, strpos(other, ':') + 1) AS value, count(*) AS n FROM records GROUP BY ALL"))
def parse_handle(spark, sf):
    return t.records(spark, sf).groupBy("other", H.scheme(F.col("other")).alias("scheme"), H.value(F.col("other")).alias("value")).agg(F.count("*").alias("n"))


@query("canon_handle", sql("records", "SELECT DISTINCT other, other AS canon, CASE WHEN other LIKE 'tel:%' THEN 'tel:...' || right(other, 4) ELSE other END AS masked FROM records"))
def canon_handle(spark, sf):
    return t.records(spark, sf).select("other", H.canon_handle(F.col("other")).alias("canon"), H.mask_handle(F.col("other")).alias("masked")).distinct()


@query("pretty_handle", sql("records", "SELECT DISTINCT other, CASE WHEN other LIKE 'tel:%' THEN '+1 ' || substr(other, 7, 3) || ' ' || substr(other, 10, 3) || ' ' || substr(other, 13, 4) ELSE substr(other, 8) END AS pretty FROM records"))
def pretty_handle(spark, sf):
    return t.records(spark, sf).select("other", H.pretty_handle(F.col("other")).alias("pretty")).distinct()


@query("is_short_code", sql("thread_records", "SELECT sender = 'tel:+22395' AS short_code, sender LIKE 'mailto:support%' AS automated, count(*) AS n FROM thread_records GROUP BY ALL"))
def is_short_code(spark, sf):
    return t.thread_records(spark, sf).groupBy(H.is_short_code(F.col("sender")).alias("short_code"), H.is_automated(F.col("sender")).alias("automated")).agg(F.count("*").alias("n"))


@query("is_automated_sender", "SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS automated FROM supplier")
def is_automated_sender(spark, sf):
    local = F.when(F.col("s_suppkey") % 3 == 0, "no-reply").otherwise("anna")
    return t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), H.is_automated(F.concat(F.lit("mailto:"), local, F.lit("@x.example.com"))).alias("automated"))


@query("name_norm", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def name_norm(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.name_norm(F.col("text")).alias("norm"))


@query("content_words", sql("projects", f"SELECT id, array_to_string(list_sort({words('title')}), ' ') AS words FROM projects"))
def content_words(spark, sf):
    return t.projects(spark, sf).select("id", F.array_join(F.array_sort(T.content_words(F.col("title"))), " ").alias("words"))


@query("jaccard", sql("projects", f"SELECT a.id AS a, b.id AS b, round({jaccard_sql(words('a.title'), words('b.title'))}, 6) AS score FROM projects a JOIN projects b ON a.company = b.company AND a.size = b.size AND a.id < b.id"))
def jaccard(spark, sf):
    p = t.projects(spark, sf).select("company", "size", "id", F.array_sort(T.content_words(F.col("title"))).alias("value"))
    return scored_pairs(p, ["company", "size"], lambda x, y: F.round(T.jaccard(x, y), 6))


@query("edit_distance", sql("projects", "SELECT a.id AS a, b.id AS b, CAST(levenshtein(a.title, b.title) AS BIGINT) AS distance FROM projects a JOIN projects b ON a.company = b.company AND a.size = b.size AND a.id < b.id"))
def edit_distance(spark, sf):
    p = t.projects(spark, sf).select("company", "size", "id", F.col("title").alias("value"))
    return scored_pairs(p, ["company", "size"], lambda x, y: F.levenshtein(x, y).cast("bigint")).withColumnRenamed("score", "distance")


@query("company_key", "SELECT s_suppkey AS id, 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS key FROM supplier")
def company_key(spark, sf):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ", Inc.").otherwise(" Holdings GmbH Ltd"))
    return t.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), T.company_key(F.regexp_replace(name, " Holdings", "")).alias("key"))


@query("fingerprint", sql("projects", "SELECT id, left(sha1(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g'))), 16) AS fp FROM projects"))
def fingerprint(spark, sf):
    return t.projects(spark, sf).select("id", T.fingerprint(F.col("title"), F.col("company")).alias("fp"))


@query("estimate_tokens", sql("notes", "SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM notes GROUP BY source"))
def estimate_tokens(spark, sf):
    return t.notes(spark, sf).groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query("one_line", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM documents")
def one_line(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("slug_tag", sql("projects", "SELECT id, trim(regexp_replace(lower(title || ' ' || company), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM projects"))
def slug_tag(spark, sf):
    return t.projects(spark, sf).select("id", T.slug_tag(F.concat_ws(" ", "title", "company")).alias("slug"))


@query("title_case", sql("projects", "SELECT id, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS title FROM projects"))
def title_case(spark, sf):
    return t.projects(spark, sf).select("id", T.title_case(F.col("title")).alias("title"))


@query("ensure_sentence", sql("projects", "SELECT id, upper(left(title, 1)) || substr(title, 2) || '.' AS sentence FROM projects"))
def ensure_sentence(spark, sf):
    return t.projects(spark, sf).select("id", T.ensure_sentence(F.col("title")).alias("sentence"))


@query("safe_file_name", sql("projects", "SELECT id, title || ' ' || company AS name FROM projects".replace("company", "replace(company, '#', ' ')")))
def safe_file_name(spark, sf):
    return t.projects(spark, sf).select("id", T.safe_file_name(F.concat_ws(" ", "title", "company")).alias("name"))


@query("norm_subject", sql("projects", f"SELECT id, {norm('title')} AS subject FROM projects"))
def norm_subject(spark, sf):
    return t.projects(spark, sf).select("id", T.norm_subject(F.concat(F.lit("Re: FW: "), "title")).alias("subject"))


@query("trim_words")
def trim_words(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.trim_words(F.col("text"), 200).alias("cut"))


@query("clean_dashes")
def clean_dashes(spark, sf):
    return t.projects(spark, sf).select("id", T.clean_dashes(F.concat_ws(" -- ", "title", "company", "type")).alias("text"))


@query("privacy_fold")
def privacy_fold(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.privacy_fold(F.col("text")).alias("folded"))


@query("clean_email_text")
def clean_email_text(spark, sf):
    body = F.concat("text", F.lit("\n\nOn Mon, Jan 1, 2024 at 9:00 Ann wrote:\n> earlier\n"))
    return t.thread_records(spark, sf).select("id", T.clean_email_text(body).alias("own"))


@query("html_to_text")
def html_to_text(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("sanitize_text")
def sanitize_text(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.sanitize_text(F.col("text")).alias("text"))


@query("clean_text")
def clean_text(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("scrub_text")
def scrub_text(spark, sf):
    return P.scrub_text(t.read(spark, sf, "documents").select("doc_id", "text"))


@query("find_sensitive")
def find_sensitive(spark, sf):
    return P.scrub_text(t.read(spark, sf, "documents").select("doc_id", "text")).where("scrubbed <> text").select("doc_id", F.size("redactions").alias("found"))


@query("luhn_valid", "SELECT p_partkey AS id, (list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN (length(s) - i) % 2 = 1 THEN CASE WHEN CAST(s[i] AS INTEGER) * 2 > 9 THEN CAST(s[i] AS INTEGER) * 2 - 9 ELSE CAST(s[i] AS INTEGER) * 2 END ELSE CAST(s[i] AS INTEGER) END)) % 10) = 0 AS valid FROM (SELECT p_partkey, CAST(4000000000000000 + p_partkey * 7919 AS VARCHAR) AS s FROM part)")
def luhn_valid(spark, sf):
    return t.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.luhn_valid((F.lit(4_000_000_000_000_000) + F.col("p_partkey") * 7919).cast("string")).alias("valid"))


@query("iban_valid", "SELECT p_partkey AS id, CAST(CAST(n || '131400' AS HUGEINT) + p_partkey % 100 AS HUGEINT) % 97 = 1 AS valid FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 AS VARCHAR), 18, '3') AS n FROM part)")
def iban_valid(spark, sf):
    n = F.lpad((F.col("p_partkey") * 7919).cast("string"), 18, "3")
    return t.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.iban_valid(F.concat(F.lit("DE"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), n)).alias("valid"))


@query("classify_message", sql("thread_records", "SELECT CASE WHEN length(trim(text)) < 2 THEN 'noise' ELSE 'content' END AS class, count(*) AS n FROM thread_records GROUP BY ALL"))
def classify_message(spark, sf):
    return t.thread_records(spark, sf).groupBy(T.classify_message(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("is_request", sql("thread_records", "SELECT id, regexp_matches(text, '\\?\\s*$') OR regexp_matches(text, '(?i)\\b(please|pls|lmk|send me|let me know|por favor)\\b') AS request FROM thread_records"))
def is_request(spark, sf):
    return t.thread_records(spark, sf).select("id", T.is_request(F.col("text")).alias("request"))


@query("is_calendar_noise", sql("projects", "SELECT id, id % 4 = 0 OR id % 4 = 1 AS noise FROM projects"))
def is_calendar_noise(spark, sf):
    title = F.when(F.col("id") % 4 == 0, "Focus time!").when(F.col("id") % 4 == 1, F.concat(F.lit("Cancelled: "), "title")).otherwise(F.col("title"))
    return t.projects(spark, sf).select("id", T.is_calendar_noise(title).alias("noise"))


@query("iso_week", sql("commitments", "SELECT strftime(date, '%G-W%V') AS week, count(*) AS n FROM commitments GROUP BY ALL"))
def iso_week(spark, sf):
    return t.commitments(spark, sf).groupBy(D.iso_week(F.col("date")).alias("week")).agg(F.count("*").alias("n"))


@query("local_date", sql("records", "SELECT strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM records GROUP BY ALL"))
def local_date(spark, sf):
    return t.records(spark, sf).groupBy(D.local_date(F.col("ts"), "America/New_York").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("local_hour_minute", sql("records", "SELECT CAST(extract(hour FROM ts - INTERVAL 5 HOUR) AS BIGINT) AS hour, count(*) AS n FROM records GROUP BY ALL"))
def local_hour_minute(spark, sf):
    return t.records(spark, sf).groupBy(D.local_hour_minute(F.col("ts"), "America/New_York")["hour"].cast("bigint").alias("hour")).agg(F.count("*").alias("n"))


@query("day_bounds", sql("commitments", "SELECT DISTINCT strftime(date, '%Y-%m-%d') AS day, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS since, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) + 86400 AS until FROM commitments"))
def day_bounds(spark, sf):
    b = D.day_bounds(F.col("date"), "UTC")
    return t.commitments(spark, sf).select(F.col("date").cast("string").alias("day"), F.unix_seconds(b["since"]).alias("since"), F.unix_seconds(b["until"]).alias("until")).distinct()


@query("zoned_to_utc", sql("records", "SELECT id, CAST(floor(epoch(ts)) AS BIGINT) + 18000 AS utc FROM records"))
def zoned_to_utc(spark, sf):
    return t.records(spark, sf).select("id", F.unix_seconds(D.zoned_to_utc(F.col("ts"), "America/New_York")).alias("utc"))


@query("days_between", sql("commitments", "SELECT id, CAST(date_diff('day', date, DATE '2001-08-02') AS BIGINT) AS age FROM commitments"))
def days_between(spark, sf):
    return t.commitments(spark, sf).select("id", F.datediff(F.lit(t.ORDERS_NOW).cast("date"), "date").cast("bigint").alias("age"))


@query("from_apple_time", sql("records", "SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records"))
def from_apple_time(spark, sf):
    s = F.unix_seconds("ts") - 978_307_200
    raw = F.when(F.col("user_id") % 2 == 0, s).otherwise(s * 1_000_000_000)
    return t.records(spark, sf).select("id", F.unix_seconds(D.from_apple_time(raw)).alias("s"))


@query("from_unix_time", sql("records", "SELECT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM records"))
def from_unix_time(spark, sf):
    s = F.unix_seconds("ts")
    raw = F.when(F.col("user_id") % 3 == 0, s).when(F.col("user_id") % 3 == 1, s * 1000).otherwise(s * 1_000_000)
    return t.records(spark, sf).select("id", F.unix_seconds(D.from_unix_time(raw)).alias("s"))


@query("loose_date", sql("commitments", "SELECT id, CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) + 34200 AS s FROM commitments"))
def loose_date(spark, sf):
    text = F.when(F.col("id") % 2 == 0, F.concat(F.col("date").cast("string"), F.lit(" 09:30:00"))).otherwise(F.concat(F.col("date").cast("string"), F.lit("T09:30:00Z")))
    return t.commitments(spark, sf).select("id", F.unix_seconds(D.loose_date(text)).alias("s"))


@query("source_of_ref", sql("items", "SELECT split_part(ref, ':', 1) AS source, count(*) AS n FROM items GROUP BY ALL"))
def source_of_ref(spark, sf):
    return t.items(spark, sf).groupBy(T.source_of_ref(F.col("ref")).alias("source")).agg(F.count("*").alias("n"))


@query("transcript_text", sql("thread_records", "SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) AS transcript FROM thread_records WHERE trim(text) <> '' GROUP BY conv_id"))
def transcript_text(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")))
    return t.thread_records(spark, sf).groupBy("conv_id").agg(T.transcript_text(turns).alias("transcript"))


@query("address_list", sql("contacts", "SELECT card, name, mail AS handle FROM contacts"))
def address_list(spark, sf):
    c = t.contacts(spark, sf)
    raw = F.concat(F.lit("nobody, "), "name", F.lit(" <"), H.value(F.col("mail")), F.lit(">"))
    return c.select("card", F.explode(T.address_list(raw)).alias("p")).select("card", F.col("p.name").alias("name"), F.col("p.handle").alias("handle"))


@query("validate_record", sql("records", "SELECT kind, CASE WHEN kind = 'event' THEN 1 ELSE 0 END AS n_errors, count(*) AS n FROM records GROUP BY ALL"))
def validate_record(spark, sf):
    bad = P.validate_record(t.records(spark, sf), ["message", "email", "call", "meeting"])
    return bad.groupBy("kind", F.size("errors").alias("n_errors")).agg(F.count("*").alias("n"))


_RULES = {"handles": ["tel:+15551000001"], "domains": ["example2.com"], "people": [], "keywords": ["widget"], "categories": ["banking", "health", "passwords", "family"], "accounts": [], "chats": []}


def _judged(spark, sf):
    r = t.records(spark, sf).withColumns({"sender": F.col("other"), "sender_name": F.lit(None).cast("string"), "title": F.lit(""), "text": F.lit(""), "account": F.lit(None).cast("string"), "chat": F.lit(None).cast("string"), "members": F.when(F.col("user_id") % 5 == 0, 9).otherwise(2)})
    return P.filter_record(r, _RULES)


_VERDICT = """judged AS (SELECT *, CASE WHEN other = 'tel:+15551000001' THEN 'handle' WHEN other LIKE '%@example2.com' THEN 'domain' END AS reason,
    CASE WHEN other = 'tel:+15551000001' OR other LIKE '%@example2.com' THEN CASE WHEN kind IN ('message', 'email') AND user_id % 5 <> 0 THEN 'thread' ELSE 'record' END END AS scope FROM records)"""


@query("filter_record", sql("records", "SELECT reason, scope, reason IS NULL AS keep, count(*) AS n FROM judged GROUP BY ALL", _VERDICT))
def filter_record(spark, sf):
    return _judged(spark, sf).groupBy("reason", "scope", "keep").agg(F.count("*").alias("n"))


@query("excluded_thread_anti_join", sql("records", "SELECT id FROM judged WHERE reason IS NULL AND thread NOT IN (SELECT thread FROM judged WHERE scope = 'thread')", _VERDICT))
def excluded_thread_anti_join(spark, sf):
    return P.purge_excluded(_judged(spark, sf)).select("id")


@query("rule_keywords", sql("projects", "SELECT id, list_contains(string_split(title, ' '), 'widget') AS hit FROM projects"))
def rule_keywords(spark, sf):
    return t.projects(spark, sf).select("id", P.rule_keywords(F.col("title"), ["widget"]).alias("hit"))


@query("rule_party", sql("contacts", "SELECT card, CASE WHEN card IN (5, 7) THEN 'handle' WHEN card % 40 = 3 THEN 'domain' END AS reason FROM contacts"))
def rule_party(spark, sf):
    rules = {"handles": ["tel:+15551000005", "mailto:person7@example7.com"], "domains": ["example3.com"]}
    both = F.coalesce(P.party_reason(F.col("phone"), F.lit(""), rules), P.party_reason(F.col("mail"), F.lit(""), rules))
    return t.contacts(spark, sf).select("card", both.alias("reason"))


@query("usable_call", sql("records", "SELECT id FROM records WHERE kind = 'call' AND duration_s >= 30"))
def usable_call(spark, sf):
    return t.records(spark, sf).where((F.col("kind") == "call") & (F.col("duration_s") >= 30)).select("id")


@query("usable_note", sql("notes", f"SELECT id FROM notes WHERE length({norm('text')}) >= 40"))
def usable_note(spark, sf):
    return t.notes(spark, sf).where(F.length(T.name_norm(F.col("text"))) >= 40).select("id")


@query("allow_list_projection", sql("notes", "SELECT id, CASE WHEN regexp_full_match(source, '[A-Za-z0-9_.:-]{1,64}') THEN source END AS source, CASE WHEN regexp_full_match(text, '[A-Za-z0-9_.:-]{1,64}') THEN text END AS text FROM notes"))
def allow_list_projection(spark, sf):
    only = lambda c: F.when(F.col(c).rlike(r"^[A-Za-z0-9_.:-]{1,64}$"), F.col(c)).alias(c)
    return t.notes(spark, sf).select("id", only("source"), only("text"))
