"""How the test tables become ours, once in Spark and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWNER = "mailto:owner@example.com"
#: Now, for events and conversations, and for orders.
NOW, ORDERS_NOW = "2024-02-01 00:00:00", "2001-08-02"
_START = 1_704_067_200  # 2024-01-01


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _person(key: str):
    number = F.concat(F.lit("tel:+1555"), (F.col(key) + 1_000_000).cast("string"))
    mail = F.concat(F.lit("mailto:person"), F.col(key).cast("string"), F.lit("@example"), (F.col(key) % 40).cast("string"), F.lit(".com"))
    return number, mail


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, mail, calls, meetings and events of the owner, from ``events``."""
    phone, mail = _person("user_id")
    kind = F.when(F.col("event_type") == "view", "message").when(F.col("event_type") == "click", "email").when(F.col("event_type") == "purchase", "call").when(F.col("event_type") == "signup", "meeting").otherwise("event")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("events:"), F.col("event_id").cast("string")).alias("id"),
        F.lit("events").alias("source"),
        kind.alias("kind"),
        F.concat(F.lit("t:"), F.col("user_id").cast("string")).alias("thread"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 3 == 0).alias("is_from_me"),
        F.when(F.col("user_id") % 2 == 1, phone).otherwise(mail).alias("other"),
        F.floor("value").cast("int").alias("duration_s"),
        "user_id",
    )


def thread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages, from ``conversations``."""
    sender = F.when(F.col("role") == "assistant", OWNER).when(F.col("role") == "user", F.concat(F.lit("name:person "), (F.col("conv_id") % 40).cast("string"))).otherwise("tel:+22395")
    return read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("id"),
        F.lit("conversations").alias("source"),
        F.lit("message").alias("kind"),
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("thread"),
        F.timestamp_seconds(F.lit(_START) + (F.col("conv_id") * 60 + F.col("turn")) * 60).alias("ts"),
        (F.col("role") == "assistant").alias("is_from_me"),
        sender.alias("sender"),
        "text",
        "conv_id",
        "turn",
        "role",
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes, one an hour."""
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "source", F.lit("doc").alias("kind"), F.timestamp_seconds(F.lit(_START) + F.col("doc_id") * 3600).alias("ts"), "text", "n_chars", "doc_id"
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card a customer; keys 0 to 149 are the users of ``events``."""
    phone, mail = _person("c_custkey")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("card"), F.col("c_name").alias("name"), phone.alias("phone"), mail.alias("mail"), F.col("c_mktsegment").alias("company"))


def offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of suppliers: all of a nation share one phone."""
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("card"),
        F.explode(F.array(F.concat(F.lit("tel:+1777"), (F.col("s_nationkey") + 1_000_000).cast("string")), F.concat(F.lit("mailto:supplier"), F.col("s_suppkey").cast("string"), F.lit("@example.com")))).alias("handle"),
    )


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("counterpart"),
        F.element_at(F.array(F.lit("i_owe"), F.lit("owed_to_me"), F.lit("delegated")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("direction"),
        day.alias("date"),
        F.date_add(day, 30).alias("due"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("dropped").alias("status"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated bullets of a target, each with one source ref, from ``lineitem``."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("target"), F.lit("timeline").alias("section"), F.to_date(F.col("l_shipdate").cast("timestamp")).alias("date"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("ref"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("type"), F.col("p_size").cast("int").alias("size"))


_MAIL = "'mailto:person' || {k} || '@example' || ({k} % 40) || '.com'"
_TEL = "'tel:+1555' || ({k} + 1000000)"
CTES = {
    "records": f"""records AS (SELECT 'events:' || event_id AS id, 'events' AS source,
        CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'email' WHEN 'purchase' THEN 'call' WHEN 'signup' THEN 'meeting' ELSE 'event' END AS kind,
        't:' || user_id AS thread, ts, event_id % 3 = 0 AS is_from_me,
        CASE WHEN user_id % 2 = 1 THEN {_TEL.format(k="user_id")} ELSE {_MAIL.format(k="user_id")} END AS other,
        CAST(floor(value) AS INTEGER) AS duration_s, user_id FROM events)""",
    "thread_records": """thread_records AS (SELECT 'conv:' || conv_id || '/' || turn AS id, 'conversations' AS source, 'message' AS kind, 'conv:' || conv_id AS thread,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)) AS ts, role = 'assistant' AS is_from_me,
        CASE role WHEN 'assistant' THEN 'mailto:owner@example.com' WHEN 'user' THEN 'name:person ' || (conv_id % 40) ELSE 'tel:+22395' END AS sender, text, conv_id, turn, role FROM conversations)""",
    "notes": """notes AS (SELECT 'doc:' || doc_id AS id, source, 'doc' AS kind, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS BIGINT)) AS ts, text, n_chars, doc_id FROM documents)""",
    "contacts": f"""contacts AS (SELECT c_custkey AS card, c_name AS name, {_TEL.format(k="c_custkey")} AS phone, {_MAIL.format(k="c_custkey")} AS mail, c_mktsegment AS company FROM customer)""",
    "offices": """offices AS (SELECT 's:' || s_suppkey AS card, unnest(['tel:+1777' || (s_nationkey + 1000000), 'mailto:supplier' || s_suppkey || '@example.com']) AS handle FROM supplier)""",
    "commitments": """commitments AS (SELECT o_orderkey AS id, o_custkey AS counterpart, ['i_owe', 'owed_to_me', 'delegated'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS direction,
        CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + 30 AS due, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'dropped' END AS status FROM orders)""",
    "items": """items AS (SELECT l_orderkey AS target, 'timeline' AS section, CAST(l_shipdate AS DATE) AS date, 'part:' || l_partkey AS ref, l_linenumber AS seq, l_partkey AS part, l_suppkey AS supplier FROM lineitem)""",
    "projects": """projects AS (SELECT p_partkey AS id, p_name AS title, p_brand AS company, p_type AS type, p_size AS size FROM part)""",
}


def sql(names: str, body: str, more: str = "") -> str:
    """A DuckDB query over the named table mappings; ``more`` holds further common table expressions."""
    parts = [CTES[n] for n in names.split()] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n" + body
