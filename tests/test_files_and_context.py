"""Files are taken once for each signature; contexts keep to their numbers."""

import glob
import os

from pyspark.sql import functions as F

from threadloom.operators import context
from threadloom.plans.registry import QUERIES
from threadloom.sources import files
from threadloom.storage import shared_dir


def test_unchanged_files_are_not_taken_again(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    taken = []
    run = lambda: files.ingest_changed(spark, str(folder), state, lambda paths: taken.extend(os.path.basename(p) for p in paths), "*.txt")
    for name in ("a.txt", "b.txt", "c.log"):
        (folder / name).write_text("one")
    assert run() == 2 and run() == 0 and taken == ["a.txt", "b.txt"]
    (folder / "a.txt").write_text("longer")  # other length
    os.utime(folder / "b.txt", (1, 1_000_000))  # other time
    (folder / "d.txt").write_text("new")
    assert run() == 3 and sorted(taken[2:]) == ["a.txt", "b.txt", "d.txt"] and run() == 0
    (folder / "a.txt").unlink()
    assert run() == 0


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.txt").write_text("x")
    monkeypatch.setattr(files, "PATHS", 2)
    taken = []

    def take(paths):
        if taken:
            raise RuntimeError("stopped")
        taken.extend(paths)

    try:
        files.ingest_changed(spark, str(folder), state, take)
    except RuntimeError:
        pass
    rest = []
    assert files.ingest_changed(spark, str(folder), state, rest.extend) == 2 and len({*taken, *rest}) == 4


def test_landed_files_follow_rows_not_threads(spark, tmp_path):
    ids = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 400).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    ids.write.parquet(f"{tmp_path}/events.parquet")
    root = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/landed-*"))
    got = {r["thread"]: (r["n"], r["changed"]) for r in QUERIES["file_signature_skip"](spark, str(tmp_path)).collect()}
    assert got == {f"t:{u}": (5, 5 if u % 3 == 0 else 0) for u in range(400) if u % 3 < 2}
    (landed,) = set(glob.glob(f"{root}/landed-*")) - before
    assert len(glob.glob(f"{landed}/**/*.parquet", recursive=True)) <= 24


def test_known_context_is_held_to_numbers(spark, monkeypatch):
    monkeypatch.setattr(context, "KNOWN", {"people": 3, "companies": 2, "projects": 2, "meetings": 2, "commitments": 2, "opportunities": 2, "answers": 1})
    monkeypatch.setattr(context, "DETAILED", 1)
    make = spark.createDataFrame
    people = make([(i, f"p{i}", 10 - i, [f"p{i}", "alias"], "co") for i in range(6)], "id int, title string, strength int, aliases array<string>, company string")
    meetings = make([(i, f"m{i}", i, [i % 6]) for i in range(12)], "id int, title string, date int, people array<int>")
    owed = make([(i, "t", 5 if i < 5 else None, i, 0, "open" if i % 2 else None) for i in range(8)] + [(9, "t", 5, 9, 0, "done")], "id int, text string, counterpart int, date int, due int, status string")
    chances = make([(1, "a", None, 5, None), (2, "b", 5, 7, "open"), (3, "c", 5, None, "open"), (4, "d", 0, 9, "open"), (5, "e", None, 9, "lost")], "id int, title string, counterpart int, date int, status string")
    batches = make([("x",), ("y",)], "batch string")
    got = {r["batch"]: r for r in context.known_context(batches, make([("x", 5), ("x", 5), ("x", None)], "batch string, person_id int"), people, make([("c2",), ("c1",), ("c1",)], "title string"), make([("q", "s", 1), ("p", "s", None)], "title string, status string, last_activity int"), meetings, owed, chances, make([(1, "t", 1), (2, "t", 2)], "id int, text string, at int")).collect()}
    x, y = got["x"], got["y"]
    assert [p["id"] for p in x["people"]] == [5, 0, 1] and [p["id"] for p in y["people"]] == [0, 1, 2]
    assert x["people"][0]["aliases"] == ["alias"] and x["people"][1]["aliases"] is None and [c["title"] for c in x["companies"]] == ["c1", "c2"]
    assert [m["id"] for m in x["meetings"]] == [11, 5] and [m["id"] for m in y["meetings"]] == [11, 10]
    assert [c["id"] for c in x["commitments"]] == [4, 3] and y["commitments"] == []
    assert [c["id"] for c in x["opportunities"]] == [2, 1] and [c["id"] for c in y["opportunities"]] == [1] and [a["id"] for a in y["answers"]] == [2]
