"""Recorded meetings and dictations from landed files."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import meetings as M

VTT = """WEBVTT

1
00:00:01.000 --> 00:00:03.500
<v Ana López>Hello <i>all</i></v>

00:00:04.000 --> 00:00:06.000
Ana López: and welcome

NOTE nothing

01:00:07.000 --> 01:00:09.600
Bo: Thanks
for that

00:01:00.000 --> 00:01:02.000
no one said this
"""
CC = "[Ana] 10:00:01\nHello\nall\n\n[Bo Li] 10:00:09\nHi\n[Bo Li] 10:00:12\nagain\n[Mute] 10:01:00\n"
CHAT = "10:00:01 From Ana to Everyone : see https://x.org\r\n10:00:09 From  Bo   Li: ok\nand more\n\n10:00:10 From Alex : done"
ROWS = [
    ("2026-09-10 10.30.00 Weekly sync 81234567890", "a.vtt", VTT), ("2026-09-10 10.30.00 Weekly sync 81234567890", "closed_caption.txt", CC), ("2026-09-10 10.30.00 Weekly sync 81234567890", "chat.txt", CHAT),
    ("2026-12-10 10.30.00", "closed_caption_1.txt", CC), ("odd name", "audio.m4a", ""), ("odd name", ".hidden.vtt", VTT), ("2026-09-11 08.00.00 Old", "video.mp4", ""), ("empty", "notes.md", "x"), ("only chat", "meeting_saved_new_chat.txt", CHAT),
]


def test_zoom_folders(spark):
    files = spark.createDataFrame(ROWS, "folder string, name string, value string").withColumn("modified", F.lit("2026-09-20 00:00:00").cast("timestamp"))
    old = spark.createDataFrame([("2026-09-11 08.00.00 Old", "what was heard", "provider")], "f string, text string, transcript_source string").select(F.concat(F.lit("zoom_local:"), F.substring(F.sha1("f"), 1, 16)).alias("id"), "text", "transcript_source")
    got = {json.loads(r["meta"])["folder"]: r for r in M.zoom_records(files, "Alex", "America/New_York", old).collect()}
    assert sorted(got) == ["2026-09-10 10.30.00 Weekly sync 81234567890", "2026-09-11 08.00.00 Old", "2026-12-10 10.30.00", "odd name", "only chat"]
    a, b, c, d, e = (got[k] for k in sorted(got))
    assert a["text"] == "Ana López: Hello all and welcome\nBo: Thanks for that\nno one said this" and a["title"] == "Weekly sync" and str(a["ts"]) == "2026-09-10 14:30:00"
    assert json.loads(a["meta"]) == {"item_id": sorted(got)[0], "folder": sorted(got)[0], "meeting_id": "81234567890", "transcript_source": "zoom", "duration_s": 62, "chat": "Ana: see https://x.org\nBo Li: ok\nand more\nAlex: done"}
    assert [p["name"] for p in a["recipients"]] == ["Ana López", "Bo", "Ana", "Bo Li"] and a["recipients"][0]["handle"] == "name:ana lópez" and a["thread"] == "meeting:" + a["id"]
    assert b["text"] == "what was heard" and json.loads(b["meta"])["transcript_source"] == "provider" and b["title"] == "Old"
    assert c["text"] == "Ana: Hello all\nBo Li: Hi again" and str(c["ts"]) == "2026-12-10 15:30:00" and c["title"] == "2026-12-10 10.30.00" and json.loads(c["meta"])["transcript_source"] == "zoom_captions"
    assert json.loads(d["meta"])["needs_transcript"] and str(d["ts"]) == "2026-09-20 00:00:00" and d["text"] == ""
    assert e["text"] == "" and "needs_transcript" not in e["meta"]
    assert M.zoom_records(files.limit(0), "Alex", "UTC").count() == 0


def test_files_are_read(spark, tmp_path):
    (tmp_path / "2026-09-10 10.30.00 A b").mkdir()
    (tmp_path / "2026-09-10 10.30.00 A b" / "a.vtt").write_text(VTT)
    (r,) = M.zoom_records(M.read_files(spark, str(tmp_path)), "x", "UTC").collect()
    assert r["title"] == "A b" and r["text"].startswith("Ana López: Hello all")


MEETINGS = "id string, title string, created string, modified string, ended string, participants string, notes string, summary string, speaker_map string, calendar_id string, transcript string, deleted boolean"


def test_dictation_meetings(spark):
    at, end = "2026-09-10T14:00:00.000Z", "2026-09-10T14:45:00.000Z"
    people = json.dumps([{"name": "Ana López"}, "Alex Rivera"])
    rows = [
        ("m-1", " Pilot ", at, at, end, people, None, "Agreed.", json.dumps({"spk_0": "Alex Rivera", "spk_1": {"name": "Ana López"}}), "ical-1", None, False),
        ("m-2", "gone", at, at, None, None, None, None, None, None, None, True),
        ("m-3", None, None, "2026-09-12 14:00:00", None, "Sara Kim, Mike Brennan; ", "n", None, None, None, None, None),
        ("m-4", "x", at, at, None, None, None, None, json.dumps([{"id": "a", "name": "First"}, {"id": "a", "label": "Last"}, {"id": "b"}]), None, json.dumps([{"speaker": "a", "content": "one"}, {"speaker": "b", "text": "two"}, {"text": " "}]), False),
        ("m-5", "x", at, at, None, None, None, None, "no json", None, "just text", False),
        ("m-6", "no time", None, None, None, None, None, None, None, None, "t", False),
    ]
    line = lambda s, t: json.dumps({"speaker": s, "text": t})
    files = [
        ("m-1", "a.ndjson", line("x", "raw")), ("m-1", "refined.ndjson", "\n".join([line("spk_0", "Thanks for joining."), line("spk_0", "Let us talk."), "broken {", line("spk_1", "A pilot."), line("2", "Good.")])),
        ("m-3", "refined.ndjson", "\n"), ("m-3", "b.ndjson", line("Sara Kim", "Kickoff.")), ("m-3", "c.ndjson", line("Sara Kim", "no")), ("m-3", "d.txt", "no"),
    ]
    got = {r["id"]: r for r in M.dictation_meetings(spark.createDataFrame(rows, MEETINGS), spark.createDataFrame(files, "folder string, name string, value string"), "alex rivera").collect()}
    assert sorted(got) == ["wispr:m-1", "wispr:m-3", "wispr:m-4", "wispr:m-5"]
    a, b, c, d = (got[k] for k in sorted(got))
    assert a["text"] == "Alex Rivera: Thanks for joining. Let us talk.\nAna López: A pilot.\nSpeaker 2: Good." and a["title"] == "Pilot"
    assert [tuple(p) for p in a["recipients"]] == [("name:ana lópez", "Ana López")]
    assert json.loads(a["meta"]) == {"item_id": "m-1", "summary": "Agreed.", "duration_s": 2700, "calendar_event_id": "ical-1", "speakers": ["Alex Rivera", "Ana López"]}
    assert b["text"] == "Sara Kim: Kickoff." and [p["name"] for p in b["recipients"]] == ["Sara Kim", "Mike Brennan"] and str(b["ts"]) == "2026-09-12 14:00:00" and json.loads(b["meta"])["notes"] == "n"
    assert c["text"] == "Last: one\nb: two" and d["text"] == "just text"


@pytest.mark.parametrize(("edited", "formatted", "asr", "want"), [("e", "f", "a", "e"), ("", "f", "a", "f"), (None, None, "a", "a"), (None, "", None, None)])
def test_dictations(spark, edited, formatted, asr, want):
    rows = spark.createDataFrame([(7, asr, formatted, edited, "2026-09-10 16:00:00", "app", None, 12.4, 3)], "id long, asr string, formatted string, edited string, at string, app string, url string, duration double, words int")
    got = M.dictations(rows, ("mailto:me@x.org", "Me")).collect()
    assert [r["text"] for r in got] == ([want] if want else [])
    if want:
        assert got[0]["id"] == "wispr:h:7" and json.loads(got[0]["meta"]) == {"item_id": "7", "app": "app", "duration_s": 12, "words": 3} and got[0]["kind"] == "dictation"
