"""Handed-over payloads: mail of all shapes, channel reads, finished records."""

import base64
import json

from threadloom.sources import handed as M


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def part(mime, text=None, parts=None, **more):
    return {"mimeType": mime, "body": {"data": b64(text)} if text is not None else {"size": 0}, **({"parts": parts} if parts is not None else {}), **more}


def items(spark, *values):
    return M.handed_items(spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string"))


def gmail(spark, *values, **more):
    return {r["id"]: r for r in M.gmail_records(items(spark, *values), ["mailto:owner@example.com"], **more).collect()}


def mail(key, payload, **more):
    return {"id": key, "threadId": "t", "internalDate": "1735689600000", "payload": {"headers": [{"name": "FROM", "value": "Ana Ruiz <ana@acme.com>"}], **payload}, **more}


def test_bodies(spark):
    deep = part("text/plain", "far down")
    for i in range(9):
        deep = part("multipart/mixed", parts=[part("application/pdf", body_id="x", filename=f"{i}.pdf"), deep])
    got = gmail(
        spark,
        [
            mail("plain", part("text/plain", "Hi Rob,\n\nSee you.\n")),
            mail("html", part("text/html", "<style>p{}</style><p>a &amp; b&nbsp;<b>c</b></p>\n\n <p>d</p><script>x<y</script>")),
            mail("both", part("multipart/alternative", parts=[part("text/html", "<p>no</p>"), part("text/plain", "yes")])),
            mail("related", part("multipart/mixed", parts=[part("multipart/related", parts=[part("multipart/alternative", parts=[part("text/html", "<p>only</p>")])]), part("text/calendar", "BEGIN")])),
            mail("order", part("multipart/mixed", parts=[part("multipart/alternative", parts=[part("text/plain", "first")]), part("multipart/alternative", parts=[part("text/plain", "second")])])),
            mail("empty-plain", part("multipart/alternative", parts=[part("text/plain"), part("text/html", "<i>h</i>"), part("text/plain", "late")])),
            mail("own", part("multipart/mixed", "own data", parts=[part("image/png")])),
            mail("none", part("multipart/mixed", parts=[part("image/png")]), snippet="short"),
            mail("deep", deep),
            mail("bad", {"mimeType": "text/plain", "body": {"data": "_-4"}}),
        ],
    )
    want = {"plain": "Hi Rob,\n\nSee you.\n", "html": "a & b c \nd", "both": "yes", "related": "only", "order": "first", "empty-plain": "h", "own": "own data", "none": "short", "deep": "far down", "bad": "��"}
    assert {k.removeprefix("gmail:"): r["text"] for k, r in got.items()} == want
    r = got["gmail:plain"]
    assert (r["sender"]["handle"], r["sender"]["name"], r["thread"], r["is_from_me"], r["url"]) == ("mailto:ana@acme.com", "Ana Ruiz", "email:t", False, M.MAIL_LINK + "plain")


def test_flat_mail_and_wrappers(spark):
    from pyspark.sql import functions as F

    flat = {"id": "m2", "thread_id": "th2", "subject": "Invoice", "from": "owner@example.com", "to": "client@example.com, Bo <bo@x.org>", "cc": "c@x.org", "date": "2026-09-01T10:00:00Z", "body": "Attached.", "labels": ["A"]}
    got = gmail(spark, {"messages": [flat], "account": "x"}, account=F.lit("me@x.org"))["gmail:m2"]
    assert got["is_from_me"] and got["text"] == "Attached." and got["title"] == "Invoice" and str(got["ts"]) == "2026-09-01 10:00:00"
    assert [tuple(p) for p in got["recipients"]] == [("mailto:client@example.com", None), ("mailto:bo@x.org", "Bo"), ("mailto:c@x.org", None)]
    assert json.loads(got["meta"]) == {"labels": ["A"], "account": "me@x.org"}
    dated = gmail(spark, {"threadId": "q", "payload": {"headers": [{"name": "Date", "value": "Tue, 1 Sep 2026 12:00:00 +0200 (CEST)"}]}})
    assert [*dated] == ["gmail:q:2026-09-01T10:00:00.000Z"]
    lines = gmail(spark, "\n".join([json.dumps(flat), "no json", "", json.dumps({**flat, "id": "m3"})]), "", "nothing", "[]")
    assert sorted(lines) == ["gmail:m2", "gmail:m3"]
    assert gmail(spark, {"id": "no time", "subject": "x"}) == {}


def test_channel_reads(spark):
    wrapper = {"channel": {"id": "C1", "name": "general"}, "team": "T1", "num_members": 7, "messages": [{"ts": "1735689600.000100", "user": "U1", "user_profile": {"real_name": "Ana"}, "text": "Morning!", "permalink": "https://x"}, {"ts": "1735689700.000200", "user": "U2", "text": "Hey", "thread_ts": "1735689600.000100"}]}
    lone = [{"ts": "1735689800.000300", "channel": "D9", "channel_name": "direct", "username": "Bot B", "message": "hi"}, {"id": "z", "date": "2025-01-01T00:00:00Z", "user_id": "U3"}, {"user": "U4"}]
    got = {r["id"]: r for r in M.slack_records(items(spark, wrapper, lone), ["slack:T1/U2"]).collect()}
    assert sorted(got) == ["slack:C1:1735689600.000100", "slack:C1:1735689700.000200", "slack:D9:1735689800.000300", "slack:unknown:z"]
    first, second, third = (got[k] for k in sorted(got)[:3])
    assert (first["thread"], tuple(first["sender"]), first["url"]) == ("slack:C1", ("slack:T1/U1", "Ana"), "https://x")
    assert json.loads(first["meta"]) == {"channel": "C1", "channelName": "general", "chat_name": "general", "is_group": True, "member_count": 7}
    assert second["is_from_me"] and json.loads(second["meta"])["threadTs"] == "1735689600.000100"
    assert tuple(third["sender"]) == ("name:bot b", "Bot B") and third["text"] == "hi" and not json.loads(third["meta"])["is_group"]


def test_records_pass_through(spark):
    from pyspark.sql import functions as F

    full = {"id": "x:1", "source": "x", "kind": "note", "ts": "2025-01-01T00:00:00Z", "text": "t", "from": {"handle": "name:a", "name": "A"}, "to": [{"handle": "name:b", "name": None}], "is_from_me": True, "meta": {"a": [1, {"b": 2}], "account": "old"}}
    half = {**full, "text": 5}
    found = M.passed_through(items(spark, [full, half]), F.lit("new"))
    (got,) = found.collect()
    assert json.loads(got["meta"]) == {"a": [1, {"b": 2}], "account": "new"} and tuple(got["sender"]) == ("name:a", "A") and got["is_from_me"] and found.columns == M.RECORD
    (bare,) = M.passed_through(items(spark, {k: full[k] for k in ("id", "source", "kind", "ts", "text")})).collect()
    assert bare["sender"] is None and bare["recipients"] == [] and bare["meta"] == "{}"
