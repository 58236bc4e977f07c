"""Quality rules, license scan, language id, toxicity: brute force, learning, and odd rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language_id, license_scan, quality_rules, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, inside = {}, set()
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside.update(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_stats_equal_brute_force(odd_texts):
    rng = random.Random(2)
    texts = odd_texts[:4] + odd_texts[6:] + [" ".join(rng.choice(["a", "b", "c#", "d\n", "é"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    for t in texts:
        assert quality_rules.text_stats(t)[:5] == brute_stats(t), t


def test_many_distinct_words():
    words = [f"w{i}" for i in range(9000)]
    text = " ".join([*words, *words[10:17]])
    assert quality_rules.text_stats(text)[4] == 14


def test_rules_are_learned_and_applied(spark, make):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) + ("###" if i % 4 == 0 else "") for _ in range(60)) for i in range(400)]
    docs = make(texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (9999, 0)], "doc_id long, quality int")
    rules = quality_rules.fit(docs, labels)
    assert rules and str(rules[0][0])
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs, rules).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(400))


def test_rules_without_labels(spark, make):
    docs = make(["one two", None])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(docs, empty) == []
    assert [r["kept"] for r in quality_rules.apply_rules(docs, []).collect()] == [False, False]


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_equals_brute_force(make, odd_texts):
    texts = [*odd_texts, "CC BY. cc-by cc cc by", "All rights\nreserved! General Public License; all rights  reserved", "éall rights reserved", "all rights_reserved", "allrights reserved"]
    got = license_scan.scan_licenses(make(texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t)


@pytest.mark.parametrize(
    ("text", "label", "found"),
    [
        ("Released under the MIT License.", "mit", True),
        ("released under the terms of the MIT license", "mit", True),
        ("released under an MIT license", "mit", False),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", True),
        ("Licensed under the Apache License, Version 1.1", "apache-2.0", False),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl", True),
        ("licensed under the GNU Lesser General Public License as published by the Free Software Foundation, either version 2 or any later version", "lgpl", True),
        ("licensed under the GNU Affero General Public License", "agpl", True),
        ("licensed under the GNU Affero General Public License", "lgpl", False),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa", True),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by", False),
        ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by", True),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa", True),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc", False),
        ("This is not, in any sense of the word, licensed under the MIT license", "mit", False),
        ("It is not free. It is released under the MIT license", "mit", True),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", True),
        ("Copyright (c) 2024 Some Body Ltd. All rights reserved", "reserved", True),
        ("This is not licensed under the MIT license.", "mit", False),
        ("It isn't released under the MIT license", "mit", False),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, but you must pay", "mit", False),
    ],
)
def test_templates(text, label, found):
    labels = license_scan.Scanner().scan("some words before " + text + " and after")[5].split(",")
    assert (label in labels) == found


def _license(label):
    """A text of a license: regions that may be left out stay, those to be replaced are filled."""
    return re.sub(r"\{(?:\d+|\*)\}", "some holder", license_scan.TEXTS[label][0]).replace("[", "").replace("]", "")


@pytest.mark.parametrize("label", sorted(license_scan.TEXTS))
def test_whole_licenses_are_told_apart(label):
    scan = license_scan.Scanner(notices={}).scan
    text = _license(label)
    words = text.split()
    assert scan("Copyright 2020 x " + text.upper() + " end")[5:] == (",".join(sorted({label} | ({"gpl"} if "general public license" in text else set()))), 1.0)
    for cut in (words[:-1], words[: len(words) // 2] + ["not"] + words[len(words) // 2 :], words[: len(words) // 3] + words[len(words) // 3 + 1 :]):
        assert scan(" ".join(cut))[6] < 1.0
    if label == "bsd-3-clause":
        assert "bsd-2-clause" not in scan(text)[5]


def test_gaps_have_no_limit():
    scan = license_scan.Scanner(notices={}).scan
    holder = "the authors and each of the many contributors to this work wherever they may live or work or their heirs"
    text = re.sub(r"\{\*\}", holder, license_scan.TEXTS["mit"][0]).replace("[", "").replace("]", "")
    assert scan(text)[5:] == ("mit", 1.0) and scan(text.replace("be liable for any claim", "be liable for a claim"))[6] == 0
    assert scan(("is free software you can redistribute it " * 20_000) + text)[5] == "mit"  # many beginnings, one pass


def test_rare_languages_and_letters(spark, make):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["then", "thing", "other"]) for _ in range(20)), "en") for i in range(3000)]
    rows += [(5000 + i, "zwołk grzmi " * 10, "pl") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert model["langs"] == ["en", "pl"]
    got = language_id.predict(make(["½ ²", "١٢", "zwołk grzmi", "ª", "thing other"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][:3] == ["und", "und", "pl"] and got[3]["lang_pred"] != "und" and got[4]["lang_pred"] == "en"
    assert language_id.predict(make([]), language_id.fit(make([]))).count() == 0


def test_rules_on_empty_tables(spark, make):
    rules = quality_rules.fit(make([]), spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert rules == [] and quality_rules.apply_rules(make([]), rules).count() == 0


def test_languages(spark, make, odd_texts):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "wh", "ou"], "de": ["sch", "ung", "ein", "ü", "heit"], "fr": ["eau", "que", "é", "oi", "ment"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).join(docs, "doc_id")
    held = got.where("held_out")
    assert held.count() > 60
    assert held.where("lang_pred = lang").count() >= 0.99 * held.count()
    strange = {r["doc_id"]: r for r in language_id.predict(make(odd_texts), model).collect()}
    assert len(strange) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in strange.values())
    assert [strange[i]["lang_pred"] for i in (0, 1, 2, 10)] == ["und"] * 4 and strange[3]["lang_pred"] in parts
    assert spark.createDataFrame([("und",)], "l string").count() == 1
    nothing = language_id.predict(make(["abc"]), language_id.fit(docs.where("false"))).first()
    assert nothing["lang_pred"] == "und"


CLEAN = ["table", "garden", "window", "river", "mountain", "letter", "music", "paper", "stone", "bread"]


@pytest.fixture(scope="module")
def tox_model(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly"]) for _ in range(40)]
        y = int(i % 5 == 0)
        if y:
            for w in rng.sample(("idiot", "moron", "stupid"), rng.randrange(1, 3)):
                words.insert(rng.randrange(40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")
    return docs, lab, toxicity.fit(docs, lab)


def test_toxicity_held_out(tox_model):
    docs, lab, model = tox_model
    got = toxicity.score(docs, model).join(lab, "doc_id").where("held_out")
    assert got.count() > 100
    assert got.where("predicted = toxic").count() >= 0.99 * got.count()


@pytest.mark.parametrize("hidden", ["1d10t", "id!ot", "i d i o t", "i.d.i.o.t", "iiidiiot", "m0r0n", "st*p1d".replace("*", "u"), "$tupid", "& i d i o t", "? i d i o t !", "x & 1 d i 0 t ? y", "id iot", "idi ot", "1d10t/x", "x:i*diot", "\u0456d\u0456\u043et", "i\u200bdi\u200bot", "i\u0301d\u0301iot", "\uff49\uff44\uff49\uff4f\uff54", "and/idiot"])
def test_hidden_words_are_restored(tox_model, make, hidden):
    plain = "the table and the garden by the river " * 3
    got = toxicity.score(make([plain + hidden + " here", plain]), tox_model[2]).orderBy("doc_id").collect()
    assert got[0]["score"] > got[1]["score"] and got[0]["predicted"] == 1 and got[1]["predicted"] == 0


def test_toxicity_odd_rows(tox_model, make, odd_texts):
    got = toxicity.score(make(odd_texts, [None, *range(1, len(odd_texts))]), tox_model[2]).collect()
    assert len(got) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.without_toxic(make([*odd_texts, "you idiot moron stupid " * 5]), tox_model[2])
    assert kept.count() == len(odd_texts) and "_id" in kept.columns


@pytest.mark.parametrize("spaced", ["i d i o t m o r o n", "1 d 1 0 t m 0 r 0 n", "m o r o n s t u p i d i d i o t", "a s t u p i d", "i d d i o t"])
def test_spaced_words_are_parted(tox_model, spaced):
    cost = tox_model[2]["cost"]
    reader = toxicity.Reader(cost)
    tokens, runs = toxicity.tokens_of("we say " + spaced + " today")
    assert tokens == ["we", "say", "today"] and len(runs) == 1
    found = {w for e in toxicity.EDGES for w in toxicity.restore(runs[0], cost, True, e).split(" ")}
    plain = spaced.replace(" ", "").replace("1", "i").replace("0", "o").replace("dd", "d")
    assert all(w in found for w in ("idiot", "moron", "stupid") if w in plain) and set(toxicity.word_features("river")) <= reader.text("river bank")


def test_viterbi_equals_exhaustive_search():
    cost = toxicity.language_model(np.zeros(toxicity._SIZE**3), {"idiot": 50, "moron": 20, "lost": 30, "a": 9, "to": 9})
    cases = [("1d10t", False), ("iiid!0t", False), ("l0$t", False), ("m-0.r", False), ("idiot", True), ("l00st", True), ("at0a1", True), ("t!o", True)]
    for token, spaced in cases:
        for edge in toxicity.EDGES:
            best = {}
            for path in itertools.product(*toxicity.lattice(token, spaced, edge)):
                text = "".join(o for o, _ in path)
                total = sum(p for _, p in path) + toxicity.path_cost(text, cost)
                best[text] = min(total, best.get(text, 1e9))
            least = min(best.values())
            assert best[toxicity.restore(token, cost, spaced, edge)] <= least + 1e-9


def test_long_tokens_are_decoded(tox_model):
    cost = toxicity.language_model(np.zeros(toxicity._SIZE**3), {"idiot": 50}, share=0.9999)
    assert toxicity.restore("1d10t" * 40, cost) == "idiot" * 40
    assert len(toxicity.restore("1d10t" * 20_000, cost)) == 100_000
    assert "idiot" in toxicity.restore("idiot" * 2000, tox_model[2]["cost"], True).split(" ")


def test_score_is_the_logistic_of_the_weights(tox_model):
    model = tox_model[2]
    scorer = toxicity.Scorer(model)
    found = {i for w in ("idiot", "table") for f in toxicity.word_features(w) if (i := model["features"].get(f)) is not None}
    logit = sum(model["weights"][i] for i in found) + model["weights"][-1]
    assert abs(scorer.score("1d10t table") - 1 / (1 + np.exp(-logit))) < 1e-9


def test_contrary_labels_count_once(spark, make):
    texts = ["you idiot there", "fine words here"] * 20
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)] + [(0, 0), (0, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(make(texts), toxicity.fit(make(texts), labels, folds=None)).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 2 == 0) for r in got)


def test_viterbi_follows_the_model():
    cost = toxicity.language_model(np.zeros(toxicity._SIZE**3), {"idiot": 50, "river": 50})
    assert toxicity.restore("1d10t", cost) == "idiot"
    assert toxicity.restore("rrriver", cost) == "river"


def test_operators_take_empty_tables(spark, make):
    docs = make([])
    assert quality_rules.apply_rules(docs, []).count() == 0
    assert license_scan.scan_licenses(docs).count() == 0
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).count() == 0
    assert F is not None
