"""Calendar items with rules of all frequencies, zones and exceptions, made from meetings; the SQL tests every day of every item."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans import tables as t
from threadloom.plans.q_handed import shown
from threadloom.plans.tables import sql
from threadloom.sources import calendar as C

ZONE = "America/New_York"
RULES = [None, "FREQ=WEEKLY;INTERVAL=2", "FREQ=DAILY;INTERVAL=3;COUNT=7", "FREQ=MONTHLY;BYDAY=2TU,-1FR", "FREQ=WEEKLY;BYDAY=MO,WE;UNTIL=20240215", "FREQ=MONTHLY;BYMONTHDAY=31,-2", "FREQ=YEARLY", None]
_APPLE = 978_307_200

_WHERE = {
    1: "date_diff('day', date_trunc('week', d0), date_trunc('week', d)) % 14 = 0 AND isodow(d) = isodow(d0)",
    2: "date_diff('day', d0, d) % 3 = 0",
    3: "(isodow(d) = 2 AND (day(d) - 1) // 7 = 1) OR (isodow(d) = 5 AND month(d + 7) <> month(d))",
    4: "isodow(d) IN (1, 3) AND d <= DATE '2024-02-15'",
    5: "day(d) = 31 OR d = last_day(d) - 1",
    6: "month(d) = month(d0) AND day(d) = day(d0)",
}
_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in _WHERE.items())
_CALENDAR = f"""m AS (SELECT *, CAST(substr(id, 8) AS BIGINT) AS n, date_trunc('second', ts) AS moment, CAST(substr(id, 8) AS BIGINT) // 5 % 8 AS rule FROM records WHERE kind = 'meeting' AND user_id % 10 <> 9),
z AS (SELECT *, CASE WHEN rule = 7 OR user_id % 3 = 1 THEN 'float' WHEN user_id % 3 = 0 THEN '{ZONE}' ELSE 'UTC' END AS clock, CASE WHEN rule = 7 OR user_id % 3 < 2 THEN '{ZONE}' ELSE 'UTC' END AS zone FROM m),
w AS (SELECT *, CASE WHEN rule = 7 THEN date_trunc('day', (moment AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}') WHEN clock = '{ZONE}' THEN (moment AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' ELSE moment END AS loc FROM z),
walked AS (SELECT *, CAST(loc AS DATE) AS d0, CAST(unnest(generate_series(CAST(loc AS DATE), DATE '2024-04-02', INTERVAL 1 DAY)) AS DATE) AS d FROM w),
named AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS nth FROM walked WHERE d = d0 OR CASE rule {_CASES} ELSE false END),
kept AS (SELECT *, d + (loc - date_trunc('day', loc)) AS starts FROM named WHERE (rule <> 2 OR nth <= 7) AND NOT (rule = 1 AND user_id % 2 = 0 AND d = d0 + 14)),
slots AS (SELECT *, epoch_us(starts AT TIME ZONE zone) AS us FROM kept),
told AS (SELECT *, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(make_timestamp(us + duration_s * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso_end, 'https://meet.google.com/' || user_id AS link FROM slots WHERE us <= epoch_us(TIMESTAMP '2024-04-01'))
SELECT 'calendar:' || n || CASE WHEN rule BETWEEN 1 AND 6 THEN '@' || iso ELSE '' END AS id, 'calendar' AS source, 'event' AS kind, 'calendar:series ' || n AS thread, us AS ts_us, other AS sender, 'Person ' || user_id AS sender_name, 'mailto:owner@example.com|Owner;name:guest|Guest' AS recipients,
  false AS is_from_me, 'Plan ' || n AS title, 'see ' || link || ' there' AS text, link AS url,
  '{{"start":"' || CASE WHEN rule = 7 THEN strftime(starts, '%Y-%m-%d') ELSE iso END || '","end":"' || CASE WHEN rule = 7 THEN strftime(CAST((moment + to_seconds(duration_s)) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS DATE), '%Y-%m-%d') ELSE iso_end END || '","all_day":' || (rule = 7)
    || ',"location":"Room ' || user_id || '","calendar":"Work","account":"owner@example.com","organizer":"' || other || '","conference_url":"' || link || '","status":"confirmed","my_status":"accepted","attendee_status":{{"mailto:owner@example.com":"accepted","name:guest":"tentative"}}'
    || CASE WHEN rule BETWEEN 1 AND 6 THEN ',"recurring":true' ELSE '' END || '}}' AS meta FROM told"""


def map_calendar_items(spark, sf):
    m = t.records(spark, sf).where("kind = 'meeting'").withColumn("n", F.expr("cast(substr(id, 8) as bigint)"))
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.expr("n div 5") % 8 + 1).cast("int"))
    seconds = (F.unix_seconds("ts") - _APPLE).cast("double")
    link = F.concat(F.lit("https://meet.google.com/"), F.col("user_id").cast("string"))
    all_day = F.expr("n div 5") % 8 == 7
    # an all-day time at midnight UTC is a date and no moment: moments that fall there are put down as their date in the zone
    local = lambda s: F.unix_seconds(F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds(s + _APPLE), ZONE))) - _APPLE
    stored = lambda s: F.when(all_day & (s % 86_400 == 0), local(s)).otherwise(s).cast("double")
    none = F.lit(None).cast("string")
    items = m.select(
        F.col("n").alias("rowid"),
        F.col("n").cast("string").alias("uuid"),
        F.concat(F.lit("series "), "n").alias("uid"),
        F.when(F.col("user_id") % 10 == 9, 2).otherwise(1).alias("calendar_id"),
        F.concat(F.lit("Plan "), "n").alias("summary"),
        F.concat(F.lit("see "), link, F.lit(" there")).alias("description"),
        *(none.alias(c) for c in ("url", "conference_url", "conference_detected", "location_address")),
        F.concat(F.lit("Room "), F.col("user_id").cast("string")).alias("location_title"),
        stored(seconds).alias("start_date"),
        stored(seconds + F.col("duration_s")).alias("end_date"),
        F.when(F.col("user_id") % 3 == 0, ZONE).when(F.col("user_id") % 3 == 1, C.FLOATING).otherwise("UTC").alias("start_tz"),
        all_day.alias("all_day"),
        rule.alias("rule"),
        F.lit(1).alias("status"),
        (F.col("n") * 10).alias("organizer_id"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("orig_id", "bigint"), ("orig_start", "double"), ("birthday_id", "bigint"), ("hidden", "boolean"))),
    )
    guest = lambda i, handle, name, status: F.struct((F.col("n") * 10 + i).alias("person_id"), handle.alias("handle"), name.alias("name"), F.lit(status).alias("person_status"), F.lit(False).alias("is_self"))
    who = F.array(guest(0, F.col("other"), F.concat(F.lit("Person "), F.col("user_id").cast("string")), 1), guest(1, F.lit(t.OWNER), F.lit("Owner"), 2), guest(2, F.lit("name:guest"), F.lit("Guest"), 4))
    people = m.select(F.col("n").alias("rowid"), F.explode(who).alias("p")).select("rowid", "p.*")
    gone = m.where((F.expr("n div 5") % 8 == 1) & (F.col("user_id") % 2 == 0)).select(F.col("n").alias("rowid"), (seconds + 14 * 86_400).alias("start"))
    calendars = spark.createDataFrame([(1, "Work", "owner@example.com", 0, False), (2, "Local holidays", None, 0, False)], "calendar_id int, calendar string, account string, store_type int, disabled boolean")
    return shown(C.calendar_records(items, calendars, people, gone, (t.OWNER, "Owner"), ZONE, F.lit(t.NOW).cast("timestamp")))


QUERIES = {"map_calendar_items": map_calendar_items}
_BODY, _REST = _CALENDAR.rsplit("\nSELECT ", 1)
SQL = {"map_calendar_items": sql("records", "SELECT " + _REST, _BODY)}
