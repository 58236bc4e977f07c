"""Personal data, sharding, token segments and byte-level BPE: brute force and round trips."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from threadloom.llm import byte_bpe, pii, sharding, token_binary

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, r in KINDS.items() for m in re.finditer(r, text or "") if valid(k, m[0])]


def test_spans_equal_brute_force(make, odd_texts):
    rng = random.Random(5)
    texts = [*odd_texts, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0300.1.1.1 001.002.003.004", "é😀 4111 1111 1111 1111, +1 (555) 123-4567", "4" * 5000, "a" * 20_000, "+1" + " " * 3000, "1-" * 4000 + "1", "+" * 500 + "1 2 3 4 5 6 7 8 9 0"]
    texts += ["".join(rng.choice("0123456789.@+-() ab_é😀%") for _ in range(rng.randrange(80))) for _ in range(400)]
    got = pii.span_digest(make(texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r["spans"] == ",".join(want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(w.startswith(k) for w in want) for k in KINDS)


def test_contexts_are_learned_and_masked(make):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20))
    texts = [f"words and password={key()} more" for _ in range(8)] + [f"the session_ref: {key()} is here" for _ in range(8)] + ["chapter 12345678 of the book"] * 3 + [None, "mail ann@example.com now", "card 4111111111111111 and +1 555 123 4567"]
    docs = make(texts)
    contexts = learned(docs)
    assert "password=" in contexts and "session_ref: " in contexts and "chapter " not in contexts
    masked = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert masked[0]["text"] == "words and password=[IDENTIFIER] more" and masked[0]["n_chars"] == len(masked[0]["text"])
    assert masked[16]["text"] == "chapter 12345678 of the book" and masked[19]["text"] is None
    assert masked[20]["text"] == "mail [EMAIL] now" and "[CARD]" in masked[21]["text"] and masked[21]["text"].endswith("[PHONE]")
    assert masked[0]["base"] == 2 and pii.mask(make([])).count() == 0 and pii.span_digest(make([])).count() == 0


def learned(docs):
    return {r["context"] for r in pii.bootstrap(pii.scan(docs)).collect()}


def test_entities_and_plain_words_lend_patterns(make):
    rng = random.Random(6)
    key = lambda: "sk-" + "".join(rng.choice("0123456789abcdefXYZ") for _ in range(16)) + "_q7"
    keys = [key() for _ in range(12)]
    texts = [f"note token: {k} end" for k in keys] + [f"well, my key is {k} yes" for k in keys[:6]]
    texts += [f"contact: p{i}@example.com" for i in range(9)] + ["contact: jdoe19999 there"] + [f"the year was {i}0240101 then" for i in range(1, 9)]
    contexts = learned(make(texts))
    assert {"token: ", "key is ", "contact: "} <= contexts and "year was " not in contexts
    masked = [r["text"] for r in pii.mask(make(texts)).orderBy("doc_id").collect()]
    assert masked[0] == "note token: [IDENTIFIER] end" and masked[12] == "well, my key is [IDENTIFIER] yes"
    assert masked[27] == "contact: [IDENTIFIER] there" and masked[28] == texts[28]


def test_contexts_have_no_limit(make):
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    texts = [f"{name(i)}_password_{name(i)}: x secret: k{i}{j}abc99 {name(i)}ref: k{i}{j}abc99 end" for i in range(1100) for j in range(3)]
    assert len([c for c in learned(make(texts)) if c.endswith("ref: ")]) == 1100


def test_exploded_candidates_are_not_broadcast(make, spark):
    """The size of exploded candidates is told too low; only the contexts, in a semi join, may be broadcast."""
    docs = make([f"badge no. A{i:07d}" for i in range(5)])
    plan = pii.find_spans(docs, pii.scan(docs), spark.createDataFrame([(f"c {i}",) for i in range(5_000)], "context string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan


def test_repeated_texts_keep_their_rows(make):
    got = pii.span_digest(make(["a@b.com x", "a@b.com x", None, None], [1, 1, 2, None])).collect()
    assert sorted((r["n_email"], r["spans"]) for r in got) == [(0, ""), (0, ""), (1, "email:0:7"), (1, "email:0:7")]


def test_no_python_in_the_plan(make):
    plan = pii.span_digest(make(["a@b.com"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_small_sources_are_spread(spark):
    rows = [(i, "t", f"s{i}") for i in range(2000)] + [(5000 + i, "t", s) for i, s in enumerate([None] * 40 + [""] * 40)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert got.groupby("shard").size().max() <= 52
    for own in (got[got["stratum"].isna()], got[got["stratum"] == ""]):
        assert own.groupby("shard").size().max() <= 2 and len(own) == 40


def test_shards(spark, make, odd_texts):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randrange(50), ["hot"] * 5 + ["b", "c", None]) for i in range(1000)]
    docs = spark.createDataFrame([(i, t, rng.choice(s)) for i, t, s in rows], "doc_id long, text string, source string")
    got = sharding.interleave(docs).toPandas()
    assert len(got) == 1000 and sorted(got["doc_id"]) == list(range(1000))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert set(got["stratum"].dropna()) == {"hot", "b", "c"}
    share = (got["stratum"] == "hot").mean()
    per = got.groupby("shard")["stratum"].apply(lambda s: (s == "hot").sum())
    assert (per - share * sizes).abs().max() <= 1.5
    texts = {i: t for i, t, _ in rows}
    assert all(r.size_ == len(texts[r.doc_id].encode()) + 16 and r.crc == zlib.crc32(texts[r.doc_id].encode()) for r in got.rename(columns={"size": "size_", "text_crc32": "crc"}).itertuples())
    again = sharding.interleave(docs.repartition(7)).toPandas()
    assert dict(zip(got["doc_id"], zip(got["shard"], got["slot"]), strict=True)) == dict(zip(again["doc_id"], zip(again["shard"], again["slot"]), strict=True))
    odd = sharding.interleave(make([*odd_texts, "dup", "dup"], [None, *range(1, len(odd_texts)), 99, 99])).toPandas()
    assert len(odd) == len(odd_texts) + 2 and odd["shard"].nunique() == len(odd) and sharding.interleave(make([])).count() == 0


@pytest.fixture(scope="module")
def strings(odd_texts):
    rng = random.Random(1)
    return [*odd_texts, "don't  we'll x  ", "é" * 5000, " " * 50 + "x", "\n \n x", "😀 😀😀", "1" * 400, "<|endoftext|> a", "ª. º, b", "ab" * 3000] + ["".join(rng.choice(" \n\tab'seé1.,😀 ") for _ in range(rng.randrange(60))) for _ in range(300)]


def test_byte_bpe_equals_tiktoken(make, strings):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.encode(make(strings), path, public_tokenizers.PATTERN).collect()}
    digest = {r["doc_id"]: r for r in byte_bpe.encode_digest(make(strings), path, public_tokenizers.PATTERN).collect()}
    for i, s in enumerate(strings):
        want = other.encode_ordinary(s or "")
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want and got[i]["round_trip"] and got[i]["n_tokens"] == len(want)
        assert digest[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digest[i]["decoded_sha256"] == hashlib.sha256((s or "").encode()).hexdigest()
    assert byte_bpe.encode_digest(make([]), path, public_tokenizers.PATTERN).count() == 0


def test_other_patterns_and_files_get_texts_whole(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = r"\p{L}+ ?|[^\p{L}]+"  # a match may end with the space
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["the cat sat on  the mat. yes", "a b", ""]
    assert [np.frombuffer(c, "<u4").tolist() for c in byte_bpe.ByteBpe(ranks, pattern).encode_batch(texts)] == [other.encode_ordinary(t) for t in texts]
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    changed = tmp_path / "other.json"
    changed.write_text(json.dumps(spec))
    model, coder = Tokenizer.from_file(str(changed)), token_binary.LibraryCoder(str(changed))
    assert coder.words is None
    assert [np.frombuffer(c, "<u4").tolist() for c in coder.encode_batch(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeated_rows_are_dealt_over_partitions(make):
    path = public_tokenizers.path("byte_bpe_50k.json")
    written = token_binary.write_segments(make(["same words in all"] * 400, [7] * 400), path)
    assert written.select("part").distinct().count() > 1
    assert sorted(r["start"] for r in token_binary.read_segments(written).collect()) == list(range(0, 2000, 5))


def test_long_and_short_pieces_agree():
    model = byte_bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(7)
    for _ in range(300):
        piece = bytes(rng.choice(b"theandinoresst ") for _ in range(rng.randrange(2, 33)))
        width = max(2, 1 << (len(piece) - 1).bit_length())
        assert np.frombuffer(model.merge_rows([piece], width)[0], "<u4").tolist() == model.merge_long(piece)


def test_words_go_to_the_model_of_one_coder_a_worker(monkeypatch):
    import public_tokenizers
    from threadloom.llm import token_binary

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = token_binary.worker_coder(path)
    assert token_binary.worker_coder(path) is coder and coder.bare is not None
    accents = "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha())
    words = [" " + w for w in ["the", "Quemios", "àà", "éàè", "ſtraße", *accents, *(a + "à" for a in accents), "a.b", "foo\nbar", "x\n\ny", "\xa0", "a\xa0", "don't", "a1b2", "x\x1cy"]] * 3
    assert coder._many(words) == coder._whole(words)
    plain = [" plain", " words", " éàè"]
    whole = coder._whole(plain)
    monkeypatch.setattr(coder, "model", None)  # words of letters need no cutting by the library's pattern
    monkeypatch.setattr(coder, "_whole", lambda texts: [])
    assert coder._many(plain) == whole


def test_lines_are_cut_like_words(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = token_binary.LibraryCoder(path)
    assert coder.lines
    words = ["\nThe", "\néàè", "\nſtraße", "\nx-y.z", "\n1a", "\n", "\n\n", "\n\nx", "\na\nb", "\n\xa0", "\n\xa0x", "\nx\xa0y", "\n's", "\nªb", "\n#", " a", " b\nc"] * 3
    assert coder._many(words) == coder._whole(words)
    rng = random.Random(8)
    texts = ["a\nb", "\n", "\n\n", "\n\n\n", "a\n\nb", "a\n\n\nb c", "a b\n\n", "\na", "\n\na", "it's\n's\n\n's", "end.\nStart,\nnext"] + ["".join(rng.choice("\n\n aé's.,1") for _ in range(rng.randrange(30))) for _ in range(500)]
    assert coder.encode_batch(texts) == coder._whole(texts)
    fresh = token_binary.LibraryCoder(path)
    fresh.encode_batch([f"{a}.\n{b}." for a in ("one", "two", "three") for b in ("Four", "Five", "Six")] + ["x one. two. three."])
    assert not any("\n" in w[1:] for w in fresh.words.young)  # no entry for a word's end and the next line's start together
    plain = ["\nplain", "\nwords", "\néàè"]
    whole = coder._whole(plain)
    monkeypatch.setattr(coder, "model", None)
    monkeypatch.setattr(coder, "_whole", lambda texts: [])
    assert coder._many(plain) == whole


def test_rules_are_expanded_in_few_steps():
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 60, 20_000).astype("<u4") for _ in range(4)]
    segment = token_binary.Segment(token_binary.pack(list(range(4)), docs, 50_257))
    steps = list(token_binary._in_turn(segment.rules, segment.first))
    assert len(steps) < 40 < len(segment.rules) / 10 and steps[-1][1] == len(segment.rules)
    assert all(segment.rules[a:b].max() < segment.first + a for a, b in steps)
    assert all((got == want).all() for got, want in zip(segment.documents(), docs, strict=True))
    chain = np.array([[1, 2], [10, 3], [11, 10]])
    assert token_binary.expansion_lengths(chain, 10).tolist() == [2, 3, 5] and len(token_binary.expansion_lengths(chain[:0], 10)) == 0


def test_segments_give_coded_documents():
    import numpy as np
    from threadloom.llm import token_binary

    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 30, n).astype("<u4") for n in (0, 5, 4000, 1, 0, 9000)]
    segment = token_binary.Segment(token_binary.pack(list(range(6)), docs, 50_257))
    assert len(segment.rules) and [bytes(c) for c in segment.coded()] == [np.append(d, 0).astype("<u4").tobytes() for d in docs]


def test_segments_round_trip(spark, make, strings, monkeypatch):
    monkeypatch.setattr(token_binary, "SEGMENT_TOKENS", 3000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = [*strings, *strings[:5], "a  <|endoftext|> b<|endoftext|>", "stop### don't, it's..."]
    ids = [None, *range(1, len(texts))]
    got = token_binary.token_files(make(texts, ids), path).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    at = 0
    for key in sorted(ids, key=lambda i: (i is not None, i)):
        want = [*model.encode(texts[key or 0] or "", add_special_tokens=False).ids, 0]
        r = by_id[key]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes())), key
        at += len(want)
    assert token_binary.token_files(make([]), path).count() == 0


def test_grammar_goes_on_until_no_pair_pays():
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 50_000, 600)
    parts = [np.array([1])]
    for _ in range(40):
        parts += [rng.integers(1, 50_000, 5000), passage, np.array([0])]
    body = np.concatenate(parts).astype(np.uint32)
    symbols, rules = token_binary.compress(body, 50_001)
    lengths = token_binary.expansion_lengths(rules, 50_001)
    assert lengths.max() >= 500  # the copied passage is one symbol, or nearly
    inner = (symbols[:-1] != 0) & (symbols[1:] != 0)
    left = np.unique(symbols[:-1].astype(np.uint64)[inner] << np.uint64(32) | symbols[1:][inner], return_counts=True)[1]
    assert left.max() < token_binary.LEAST
    out = {i: [i] for i in range(50_001)}
    for i, (a, b) in enumerate(rules.tolist()):
        out[50_001 + i] = out[a] + out[b]
    assert [x for y in symbols.tolist() for x in out[y]] == body.tolist()
    assert len(token_binary.compress(body[:0], 50_001)[0]) == 0 and token_binary.compress(body[:1], 50_001)[0].tolist() == [1]


def test_grammar_compresses_and_reads_at_random():
    rng = np.random.default_rng(4)
    docs = [np.tile(rng.integers(0, 50_000, 9), rng.integers(0, 60)) for _ in range(40)]
    data = token_binary.pack(list(range(40)), docs, 50_257)
    segment = token_binary.Segment(data)
    assert len(segment.rules) and len(segment.symbols) < sum(map(len, docs)) / 3
    assert all((segment.document(i) == d).all() and len(segment.document(i)) == len(d) for i, d in enumerate(docs))
    assert [len(d) for d in segment.documents()] == [len(d) for d in docs]
    assert (segment.lengths == token_binary.expansion_lengths(segment.rules, segment.first)).all()


def test_pieces_are_large_however_small_the_batches(monkeypatch):
    import pyarrow as pa

    from threadloom.llm import token_binary

    monkeypatch.setattr(token_binary, "PIECE", 1000)
    texts = ["a" * 10, None, "b" * 2500, *["c" * 100] * 40]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i]), "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)]
    pieces = list(token_binary.text_pieces(iter(batches)))
    assert [k for keys, _ in pieces for k in keys] == list(range(43)) and [t for _, some in pieces for t in some] == [t or "" for t in texts]
    assert [len(k) for k, _ in pieces] == [3, 10, 10, 10, 10] and list(token_binary.text_pieces(iter([]))) == []
