"""Calendar records: rules against an independent walk over all days, clocks, moved and cancelled slots."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from threadloom.plans import q_calendar
from threadloom.sources import calendar as C

EPOCH = dt.datetime(2001, 1, 1, tzinfo=dt.timezone.utc)
ITEM = "rowid long, uuid string, uid string, calendar_id long, summary string, description string, url string, conference_url string, conference_detected string, location_title string, location_address string, start_date double, end_date double, start_tz string, all_day boolean, rule string, status int, organizer_id long, orig_id long, orig_start double, birthday_id long, hidden boolean"
NY, NOW = "America/New_York", "2026-09-28 16:00:00"


def apple(text, zone="UTC"):
    return (dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone)) - EPOCH).total_seconds()


def item(rowid, start, minutes=30, zone="UTC", tz="UTC", **more):
    base = dict.fromkeys(c.split()[0] for c in ITEM.split(", "))
    at = apple(start, zone)
    return base | {"rowid": rowid, "uuid": f"U{rowid}", "uid": f"S{rowid}", "calendar_id": 1, "summary": " Title ", "start_date": at, "end_date": at + minutes * 60, "start_tz": tz, "all_day": False} | more


def records(spark, items, people=(), exceptions=()):
    table = spark.createDataFrame([tuple(i.values()) for i in items], ITEM)
    calendars = spark.createDataFrame([(1, "Work", "me@x.org", 0, False), (2, "US Holidays", None, 0, False), (3, "Off", None, 0, True)], "calendar_id long, calendar string, account string, store_type int, disabled boolean")
    who = spark.createDataFrame(list(people), "person_id long, rowid long, handle string, name string, person_status int, is_self boolean")
    gone = spark.createDataFrame(list(exceptions), "rowid long, start double")
    return C.calendar_records(table, calendars, who, gone, ("mailto:me@x.org", "Me"), NY, F.lit(NOW).cast("timestamp")).collect()


def test_single_events(spark):
    got = {
        r["id"]: r
        for r in records(
            spark,
            [
                item(1, "2026-09-05T15:00", organizer_id=11, location_title="Room", location_address="1 Main St", description="Join https://us02web.zoom.us/j/812?pwd=a now", status=1),
                item(2, "2026-09-06T00:00", 2880, all_day=True, tz="_float", url="https://x.org/e"),
                item(3, "2026-09-07T09:00", tz="_float"),
                item(4, "2026-12-30T09:00"),
                item(5, "2026-09-07T09:00", calendar_id=2),
                item(6, "2026-09-07T09:00", calendar_id=3),
                item(7, "2026-09-07T09:00", birthday_id=4),
                item(8, "2026-09-07T09:00", hidden=True),
                item(9, "2026-09-07T09:00", uuid=None, uid=None, calendar_id=None, end_date=None, conference_detected="zoom"),
            ],
            [(11, 1, "mailto:ana@x.org", "Ana", 2, False), (12, 1, "mailto:me@x.org", "Me", 3, True), (13, 1, None, "Bo", 1, False)],
        )
    }
    assert sorted(got) == ["calendar:U1", "calendar:U2", "calendar:U3", "calendar:row9"]
    one, two, three = (got[f"calendar:U{i}"] for i in (1, 2, 3))
    assert tuple(one["sender"]) == ("mailto:ana@x.org", "Ana") and [tuple(p) for p in one["recipients"]] == [("mailto:me@x.org", "Me"), (None, "Bo")] and not one["is_from_me"]
    assert one["title"] == "Title" and one["url"] == "https://us02web.zoom.us/j/812?pwd=a" and one["thread"] == "calendar:S1"
    assert json.loads(one["meta"]) == {
        "start": "2026-09-05T15:00:00.000Z", "end": "2026-09-05T15:30:00.000Z", "all_day": False, "location": "Room, 1 Main St", "calendar": "Work", "account": "me@x.org", "organizer": "mailto:ana@x.org",
        "conference_url": one["url"], "status": "confirmed", "my_status": "declined", "attendee_status": {"mailto:me@x.org": "declined"},
    }
    assert str(two["ts"]) == "2026-09-06 04:00:00" and json.loads(two["meta"])["start"] == "2026-09-06" and json.loads(two["meta"])["end"] == "2026-09-08" and two["url"] == "https://x.org/e"
    assert str(three["ts"]) == "2026-09-07 13:00:00" and json.loads(three["meta"])["end"] == "2026-09-07T13:30:00.000Z" and tuple(three["sender"]) == ("mailto:me@x.org", "Me")


def test_series_with_moved_and_cancelled_slots(spark):
    items = [
        item(1, "2026-10-19T09:00", zone=NY, tz=NY, rule="FREQ=WEEKLY"),
        item(2, "2026-10-27T11:00", zone=NY, tz=NY, orig_id=1, orig_start=apple("2026-10-26T09:00", NY), uid="other"),
    ]
    got = records(spark, items, exceptions=[(1, apple("2026-11-09T09:00", NY))])
    # clocks go back on 1 November: nine o'clock stays nine o'clock
    assert sorted(r["id"] for r in got) == ["calendar:U1@2026-10-19T13:00:00.000Z", "calendar:U1@2026-11-02T14:00:00.000Z", "calendar:U1@2026-11-16T14:00:00.000Z", "calendar:U1@2026-11-23T14:00:00.000Z", "calendar:U2"]
    assert {r["thread"] for r in got} == {"calendar:S1"} and all(json.loads(r["meta"])["recurring"] for r in got)


def walk(rule, start, last):
    """Days of a rule, by testing every day."""
    p = dict(x.split("=") for x in rule.split(";"))
    every, names = int(p.get("INTERVAL", 1)), C.DAYS
    by_day = [(x[:-2], names.index(x[-2:])) for x in p["BYDAY"].split(",")] if "BYDAY" in p else None
    by_date = [int(x) for x in p["BYMONTHDAY"].split(",")] if "BYMONTHDAY" in p else None
    last = min(last, dt.datetime.strptime(p["UNTIL"][:8], "%Y%m%d").date()) if "UNTIL" in p else last
    out, d = [], start
    while d <= last or d == start:
        days_in = ((d.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)).day
        if p["FREQ"] == "DAILY":
            ok = (d - start).days % every == 0 and (not by_day or d.weekday() in [w for _, w in by_day])
        elif p["FREQ"] == "WEEKLY":
            monday = lambda x: x - dt.timedelta(x.weekday())
            ok = (monday(d) - monday(start)).days // 7 % every == 0 and d.weekday() in ([w for _, w in by_day] if by_day else [start.weekday()])
        elif p["FREQ"] == "MONTHLY":
            nth, back = (d.day - 1) // 7 + 1, -((days_in - d.day) // 7 + 1)
            ok = ((d.year - start.year) * 12 + d.month - start.month) % every == 0 and (
                (d.day in by_date or d.day - days_in - 1 in by_date) if by_date else any(w == d.weekday() and (n == "" or int(n) in (nth, back)) for n, w in by_day) if by_day else d.day == start.day
            )
        else:
            ok = (d.year - start.year) % every == 0 and (d.month, d.day) == (start.month, start.day)
        if ok or d == start:
            out.append(d)
        d += dt.timedelta(1)
    return out[: int(p["COUNT"])] if "COUNT" in p else out


def test_rules_equal_a_walk_over_days(spark):
    rng, rows = random.Random(8), []
    for i in range(300):
        freq = rng.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
        rule = f"FREQ={freq}"
        if rng.random() < 0.5:
            rule += f";INTERVAL={rng.randrange(1, 5)}"
        if freq in ("DAILY", "WEEKLY") and rng.random() < 0.5:
            rule += ";BYDAY=" + ",".join(rng.sample(C.DAYS, rng.randrange(1, 4)))
        if freq == "MONTHLY" and rng.random() < 0.7:
            rule += rng.choice([";BYDAY=" + ",".join(rng.choice(["", "1", "2", "5", "-1", "-2"]) + d for d in rng.sample(C.DAYS, 2)), ";BYMONTHDAY=" + ",".join(map(str, rng.sample([1, 15, 29, 30, 31, -1, -3], 2)))])
        end = rng.random()
        rule += f";COUNT={rng.randrange(1, 9)}" if end < 0.3 else f";UNTIL=2026{rng.randrange(1, 13):02d}15" if end < 0.6 else ""
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(900), hours=9), rule))
    horizon = dt.datetime(2026, 10, 1)
    got = {}
    for r in C.expand(spark.createDataFrame(rows, "rowid long, clock timestamp, rule string"), F.lit(horizon).cast("timestamp")).collect():
        got.setdefault(r["rowid"], []).append(r["day"])
    for i, clock, rule in rows:
        assert sorted(got[i]) == walk(rule, clock.date(), horizon.date() + dt.timedelta(1)), rule


@pytest.mark.parametrize("rule", [None, "", "FREQ=HOURLY", "nonsense", "FREQ=WEEKLY;INTERVAL=0;BYDAY=XX;COUNT=1"])
def test_odd_rules_have_their_own_day(spark, rule):
    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 5, 9), rule)], "rowid long, clock timestamp, rule string")
    assert [str(r["day"]) for r in C.expand(rows, F.lit("2026-03-01").cast("timestamp")).collect()] == ["2026-01-05"]


def test_all_day_moments_at_midnight_equal_sql(spark, tmp_path):
    """Meetings that begin or end at midnight UTC are still the evening before in the zone of the calendar."""
    rows = [(i, dt.datetime(2024, 1, 5 + i // 40 % 9) - dt.timedelta(seconds=(0, 60, 25_200)[i % 3]), i % 13, "signup", 60.5, "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert oracle.compare(q_calendar.map_calendar_items(spark, str(tmp_path)), con, q_calendar.SQL["map_calendar_items"]) is None


def test_floating_starts_that_the_clocks_skip_equal_sql(spark, tmp_path):
    """Every second Sunday from 14 January falls on 10 March, when there is no time from two to three in New York; ends stay behind starts."""
    rows = [(i, dt.datetime(2024, 1, 14, 2, 20) + dt.timedelta(seconds=i * 17 % 100 * 30), 1 + i % 13, "signup", (60.5, 240.0, 2000.5)[i % 3], "{}") for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert oracle.compare(q_calendar.map_calendar_items(spark, str(tmp_path)), con, q_calendar.SQL["map_calendar_items"]) is None
