"""Exported chats of both styles to records."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import chats as C

DIRECT = "﻿[28/9/26, 9:05:01 PM] Ana López: Hola\nsecond line\n‎[28/9/26, 9:05:30 PM] Ana López: ‎Messages are end-to-end encrypted.\n[28/9/26, 21:06:00] Rob: ok <This message was edited>\n[28/9/26, 21:06:00] Rob: ok\n[28/9/26, 21:06:00] Rob: ok\n[28/9/26, 21:07:00] Ana López: ‎image omitted\n[28/9/26, 21:08:00] Ana López: This message was deleted.\n"
GROUP = "12/31/25, 11:59 PM - Alex created group\n12/31/25, 11:59 PM - ~ Alex Rivera: <attached: a b.pdf>\n1/2/26, 12:01 AM - +1 305 555 0100: hi: there\n1/2/26, 12:02 AM - Bo: see\n[1/2/26, 12:03:00] Bo: not a head here\n1/2/26, 12:04 AM - Bo: photo.jpg (file attached)\n13/13/26, 1:00 AM - Bo: no such day\n"


def records(spark, *files, **more):
    got = C.export_records(spark.createDataFrame(list(files), "file string, value string"), ("mailto:me@x.org", "Alex Rivera"), "America/New_York", **more).collect()
    return sorted(got, key=lambda r: (r["ts"], r["text"], r["id"]))


def test_direct_chat(spark):
    got = records(spark, ("WhatsApp Chat with Ana López (1).txt", DIRECT))
    assert [(r["text"], r["is_from_me"]) for r in got] == [("Hola\nsecond line", False), ("ok", True), ("ok", True), ("ok", True), ("", False)]
    first, mine, last = got[0], got[1], got[-1]
    assert str(first["ts"]) == "2026-09-29 01:05:01" and tuple(first["sender"]) == ("name:ana lópez", "Ana López") and first["recipients"] == [] and first["title"] is None
    assert tuple(mine["sender"]) == ("mailto:me@x.org", "Alex Rivera") and tuple(mine["recipients"][0]) == ("name:ana lópez", "Ana López")
    assert len({r["id"] for r in got}) == 5 and len({r["thread"] for r in got}) == 1 and first["thread"].startswith("whatsapp:export:")
    assert json.loads(last["meta"]) == {"chat_name": "Ana López", "export_file": "WhatsApp Chat with Ana López (1).txt", "media": "image"}
    assert sorted(json.loads(r["meta"]).get("edited", False) for r in got[1:4]) == [False, False, True]


def test_group_chat(spark):
    got = records(spark, ("Deal room.txt", GROUP), ("empty.txt", ""), ("no heads.txt", "just\nlines"))
    assert [r["text"] for r in got] == ["", "hi: there", "see\n[1/2/26, 12:03:00] Bo: not a head here", ""]
    a, b, c, d = got
    assert str(a["ts"]) == "2026-01-01 04:59:00" and a["is_from_me"] and json.loads(a["meta"])["attachments"] == [{"filename": "a b.pdf"}] and json.loads(d["meta"])["attachments"] == [{"filename": "photo.jpg"}]
    assert tuple(b["sender"]) == ("tel:+13055550100", None) and b["title"] == "Deal room" and b["recipients"][0]["name"] == "Deal room" and b["recipients"][0]["handle"].startswith("group:whatsapp_export:")
    assert json.loads(c["meta"])["participants"] == ["tel:+13055550100", "name:bo"] and json.loads(c["meta"])["is_group"]


def test_known_chats_lend_their_thread(spark):
    native = spark.createDataFrame([("ana LOPEZ", "whatsapp:13055551234@s.whatsapp.net", False, "13055551234@s.whatsapp.net")], "name string, thread string, is_group boolean, jid string")
    stored = spark.createDataFrame([("whatsapp:13055551234@s.whatsapp.net", "2026-09-29 01:06:45", "OK!")], "thread string, ts string, text string").selectExpr("thread", "cast(ts as timestamp) ts", "text")
    got = records(spark, ("Ana López.txt", DIRECT), native=native, stored=stored)
    assert [r["text"] for r in got] == ["Hola\nsecond line", ""] and {r["thread"] for r in got} == {"whatsapp:13055551234@s.whatsapp.net"} and got[0]["sender"]["handle"] == "tel:+13055551234"


@pytest.mark.parametrize(
    ("dates", "order"),
    [(["2026-01-02"], "ymd"), (["13/1/26"], "dmy"), (["1/13/26"], "mdy"), (["1/2/26", "2/1/26", "3/1/26"], "mdy"), (["1/2/26", "2/2/26", "1/3/26"], "dmy"), (["2/1/26", "2/3/26", "3/1/26"], "mdy"), (["1/1/26"], "dmy"), (["13/1/26", "1/13/26"], "dmy")],
)
def test_date_order(spark, dates, order):
    text = "\n".join(f"{d}, 10:00 - A: x" for d in dates)
    (r,) = spark.createDataFrame([(text,)], "value string").select(C.entries(F.col("value")).alias("e")).select(C.date_order(F.col("e")).alias("o")).collect()
    assert r["o"] == order
