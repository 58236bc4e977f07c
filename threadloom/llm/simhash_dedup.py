"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into six blocks. Two fingerprints that differ in at most
three bits agree on at least three whole blocks, so each close pair meets in
one of the twenty tables keyed by three blocks (about 32 bits); pairs that
meet are verified by their Hamming distance.

Everything is done on distinct fingerprints, so a text copied a million times
costs one row. Near copies with very many distinct fingerprints can crowd one
block key. Such a bucket isn't joined with itself: each of its fingerprints
names the points near it (see ``_crowded_links``), which costs a constant
number of rows for each fingerprint, finds the same components, and drops
nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import per_batch, small_batches, trimmed
from threadloom.operators.graph import connected_components
from threadloom.storage import materialize

#: Most differing bits of a link.
MAX_BITS = 3
_WIDTHS = (11, 11, 11, 11, 10, 10)
#: A bucket of more distinct fingerprints than this is linked through points, so a bucket makes 32 pairs a fingerprint at most.
CROWDED = 64
_STEP = 65_536


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _tables() -> list[tuple[int, list[int]]]:
    """Mask of the three kept blocks of each table, and the bits that are free."""
    starts = [sum(_WIDTHS[:i]) for i in range(len(_WIDTHS))]
    out = []
    for kept in combinations(range(len(_WIDTHS)), len(_WIDTHS) - MAX_BITS):
        bits = [b for i in kept for b in range(starts[i], starts[i] + _WIDTHS[i])]
        out.append((_signed(sum(1 << b for b in bits)), [b for b in range(64) if b not in set(bits)]))
    return out


def fold_bits(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of unsigned hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _STEP):
        part = hashes[start : start + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_text(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text's word shingles, repeats included; zero without words.

    A-Z are lower-cased, words are what ASCII white space separates, a shingle
    is hashed as XXH64 of its words joined by spaces; a text of fewer words is
    one shingle.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(parts) - words + 1)].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))
    return fold_bits(hashes)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` of every row; a null text counts as empty."""

    def make():
        def work(batch):
            return {"doc_id": batch["doc_id"], "fp": [fingerprint_text(t, words, seed) for t in batch["text"]]}

        return work

    return per_batch(docs.select("doc_id", "text"), make, "doc_id bigint, fp bigint")


def _literal(values: list[list[int]]) -> Column:
    return F.expr("array(" + ",".join("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "-9223372036854775807L - 1L" for v in some) + ")" for some in values) + ")")


def _crowded_links(rows: DataFrame) -> DataFrame:
    """Links of crowded buckets by way of points, without pairs.

    Inside a bucket only the free bits differ. Cut them in two halves: of any
    three bits, two lie in the same half. So x and y differ in at most three
    bits exactly if some point lies within one bit of x and within two bits of
    the same half of y. Every fingerprint names its points of both kinds (about
    300 in all); where a point has an x, its y are all linked to the smallest x.
    A point has a bounded number of fingerprints, however large the bucket.
    """
    near, far = [], []
    for _, free in _tables():
        halves = free[: len(free) // 2], free[len(free) // 2 :]
        near.append([0, *(_signed(1 << b) for b in free)])
        far.append([_signed(1 << a | 1 << b) for half in halves for a, b in combinations(half, 2)])
    points = rows.withColumn("flip", F.explode(F.element_at(_literal(near), F.col("t") + 1))).withColumn("x", F.lit(True)).unionByName(
        rows.withColumn("flip", F.explode(F.element_at(_literal(far), F.col("t") + 1))).withColumn("x", F.lit(False))
    )
    met = points.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(
        F.min(F.when(F.col("x"), F.col("fp"))).alias("src"), F.collect_list("fp").alias("all")
    )
    return met.where("src is not null and size(all) > 1").select("src", F.explode("all").alias("dst")).where("src <> dst")


def hamming_links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``(src, dst)`` links among distinct ``fp`` values that join exactly those within ``MAX_BITS`` into components.

    Up to ``crowded`` fingerprints in a bucket, these are all close pairs of it.
    """
    masks = F.expr("array(" + ",".join(f"named_struct('t', {t}, 'm', {m}L)" for t, (m, _) in enumerate(_tables())) + ")")
    rows = distinct.select("fp", F.explode(masks).alias("k")).select(F.col("k.t").alias("t"), F.col("fp").bitwiseAND(F.col("k.m")).alias("block"), "fp")
    sizes = rows.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1")
    # merged whatever their size: Spark counts none of the twenty rows that a fingerprint becomes, and would broadcast them
    shared = materialize(rows.join(sizes.hint("merge"), ["t", "block"]), "blocks")
    few = shared.where(F.col("n") <= crowded)
    pairs = (
        few.alias("a")
        .join(few.alias("b").hint("merge"), F.expr(f"a.t = b.t and a.block = b.block and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {MAX_BITS}"))
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    return pairs.unionByName(_crowded_links(shared.where(F.col("n") > crowded).select("t", "block", "fp")))


def near_duplicate_groups(docs: DataFrame, words: int = 3, seed: int = 42, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents linked through fingerprints at most three bits apart.

    ``component_id`` is the smallest doc_id that can be reached, itself
    included. Null and wordless texts have fingerprint zero and are linked
    like any other. Repeated rows are kept, each with its component; a null
    doc_id gets a component but never names one unless all its group is null.
    An empty table gives no rows; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, words, seed), "fingerprints")
    first = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "first")
    roots = connected_components(hamming_links(first.select("fp"), crowded), "src", "dst")
    rooted = materialize(first.join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    linked = materialize(rooted.join(lowest, "root").select("fp", "linked_id"), "linked")
    named = first.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


#: Seeds of the fingerprints that propose near copies; fixed odd numbers.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of the shingles that propose, words of those that decide, and the similarity that makes a near copy.
PROPOSE_WORDS, WORDS, SIMILAR = 2, 5, 0.8
#: Turns in which each bucket of a shingle is held against one of its texts; they save pairs and drop none.
STARS = 1
_BIN_BITS, _BIN_MASK, _PIECES = 20, np.uint64((1 << 20) - 1), 16
_NO_ID = 2**63 - 1


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Hashes of word shingles by way of word hashes, which a bounded memo holds."""

    def __init__(self, most: int = 100_000):
        self.most, self.memo = most, {}

    def hashes(self, text: str | None, words: int) -> np.ndarray:
        """One 64-bit hash a shingle, in order; a text of fewer words is one shingle, one of none has none."""
        from xxhash import xxh64_intdigest

        if len(self.memo) > self.most:
            self.memo.clear()
        memo, out = self.memo, []
        for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
            if (h := memo.get(w)) is None:
                h = memo[w] = xxh64_intdigest(w)
            out.append(h)
        if not out:
            return np.zeros(0, dtype=np.uint64)
        w = np.array(out, dtype=np.uint64)
        if len(w) < words:
            w = np.concatenate([w, np.zeros(words - len(w), dtype=np.uint64)])
        n = len(w) - words + 1
        h = np.zeros(n, dtype=np.uint64)
        for i in range(words):
            h = _mix(h + w[i : i + n] * np.uint64(SEEDS[0]))
        return h


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key of their text's class of exact copies; null counts as empty, rows without id come last."""
    return docs.withColumn("_key", F.md5(F.coalesce("text", F.lit("")))).withColumn("_id", F.coalesce("doc_id", F.lit(_NO_ID)))


def _shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Texts a shingle occurs in, counted by bins of its hash; a task sends sums in pieces, never shingles.

    Bins only order shingles from rare to common, so two in one bin cost time, never a pair.
    """

    def count(batches):
        import pyarrow as pa

        shingler, sums, held, size = Shingler(), np.zeros(1 << _BIN_BITS, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(np.unique(shingler.hashes(text.as_py(), words)))
                size += len(held[-1])
                if size > _STEP * 8:
                    sums += np.bincount((np.concatenate(held) & _BIN_MASK).astype(np.int64), minlength=len(sums))
                    held, size = [], 0
        if held:
            sums += np.bincount((np.concatenate(held) & _BIN_MASK).astype(np.int64), minlength=len(sums))
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(_PIECES), pa.int32()), "n": pa.array([x.tobytes() for x in np.split(sums, _PIECES)], pa.binary())})

    def add(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(n, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "n": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    shape, out = "piece int, n binary", np.zeros((_PIECES, (1 << _BIN_BITS) // _PIECES), dtype=np.int64)
    small_batches(docs.sparkSession)
    for piece, n in docs.select("text").mapInArrow(trimmed(count), shape).repartition(_PIECES, "piece").mapInArrow(trimmed(add), shape).collect():
        out[piece] = np.frombuffer(bytes(n), dtype=np.int64)
    return out.reshape(-1)


def prefix_of(shingles: np.ndarray, counts: np.ndarray, similar: float) -> np.ndarray:
    """The rarest of distinct shingles, rarest first: as many that any set of at least ``similar`` holds one of them among its own."""
    order = np.lexsort((shingles, counts[(shingles & _BIN_MASK).astype(np.int64)]))
    return shingles[order[: len(shingles) - int(np.ceil(similar * len(shingles) - 1e-9)) + 1]] if len(shingles) else shingles


def sketch_of(shingles: np.ndarray) -> list[int]:
    """Parities of distinct shingles over 256 bins, as four longs.

    A shingle of only one of two sets turns one bit, so two sketches differ in at most as many bits as the sets in shingles.
    """
    bins = (_mix(shingles) >> np.uint64(56)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=256) & 1).astype(np.uint8)).view(np.int64).tolist()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, similar: float, words: int) -> DataFrame:
    """Those pairs ``(src, dst)`` of class keys whose sets of shingles are similar enough; only texts in pairs are shuffled."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("key")).distinct().join(classes.select("key", "text_key", "first_id"), "key")

    def shingled():
        shingler = Shingler()

        def work(batch):
            return {"key": batch["key"], "shingles": [np.unique(shingler.hashes(t, words)).view(np.int64).tolist() for t in batch["text"]]}

        return work

    texts = _keyed(docs).select("_key", "_id", "text").join(ends.withColumnRenamed("first_id", "_id"), "_id").where("_key = text_key").select("key", "text")
    sets = per_batch(texts, shingled, "key bigint, shingles array<bigint>").groupBy("key").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "shingles")
    both = pairs.join(sets.select(F.col("key").alias("src"), F.col("shingles").alias("x")), "src").join(sets.select(F.col("key").alias("dst"), F.col("shingles").alias("y")), "dst")
    common = F.size(F.array_intersect("x", "y"))
    tested = both.select("src", "dst", common.alias("c"), (F.size("x") + F.size("y") - common).alias("u")).where(F.col("c") >= similar * F.col("u"))
    return materialize(tested.select("src", "dst"), "links")


def _with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of the component of their ``key``."""
    roots = connected_components(links).select(F.col("node").alias("key"), "root")
    return rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _entries(classes: DataFrame) -> DataFrame:
    """``(shingle, key, size, pos)`` of prefix shingles that several texts share."""
    shared = classes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared.select("shingle"), "shared")
    # a semi join can only broadcast what is shared, whose size is that of its file; that of the exploded side is told too low
    return materialize(classes.select("key", "size", F.posexplode("prefix").alias("pos", "shingle")).join(shared, "shingle", "left_semi"), "entries")


def _open(entries: DataFrame, links: DataFrame, sketches: DataFrame) -> DataFrame:
    """Entries, with their roots and sketches, of shingles that texts of different components share."""
    rooted = materialize(_with_roots(entries, links), "rooted")
    several = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    return materialize(rooted.join(several.select("shingle", "n").hint("merge"), "shingle").join(sketches, "key"), "open")


def _could_reach(similar: float) -> Column:
    """True unless sizes, the shingles that follow the first common one, or the sketches rule the similarity out."""
    most = F.least(F.expr("a.size - a.pos"), F.expr("b.size - b.pos"))
    both = F.col("a.size") + F.col("b.size")
    differ = F.expr(" + ".join(f"bit_count(a.sketch[{i}] ^ b.sketch[{i}])" for i in range(4)))
    sizes = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * similar - 1e-6
    return sizes & (most >= both * (similar / (1 + similar)) - 1e-6) & (differ <= both * ((1 - similar) / (1 + similar)) + 1e-6)


def near_copy_links(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Classes of exact copies ``(key, text_key, first_id, n)``, and verified links ``(src, dst)`` between class keys.

    A pair is a link if the sets of five-word shingles have a Jaccard
    similarity of at least ``similar``; links join exactly the components of
    all such pairs. Fingerprints propose pairs first, which joins most copies
    cheaply. What they miss is found by prefixes: two sets of that similarity
    share one of their rarest shingles, so only texts of different components
    that share one can be similar. Such a bucket of texts is first held
    against one text of its most frequent component, which costs a row for
    each; a text has many shingles and so meets many members of a family. Then
    all pairs that are left in different components are tested, in buckets of
    any size, unless their sketches prove that the sets differ too much. No
    turn drops a pair that is similar.
    """
    counts = docs.sparkSession.sparkContext.broadcast(_shingle_counts(docs, words))

    def make():
        shingler = Shingler()

        def marks(text):
            h = shingler.hashes(text, PROPOSE_WORDS)
            return [fold_bits(_mix(h ^ np.uint64(s))) for s in SEEDS]

        def work(batch):
            sets = [np.unique(shingler.hashes(t, words)) for t in batch["text"]]
            return {
                "text_key": batch["_key"],
                "id": batch["_id"],
                "fps": [marks(t) for t in batch["text"]],
                "size": [len(x) for x in sets],
                "prefix": [prefix_of(x, counts.value, similar).view(np.int64).tolist() for x in sets],
                "sketch": [sketch_of(x) for x in sets],
            }

        return work

    rows = per_batch(_keyed(docs).select("_key", "_id", "text"), make, "text_key string, id bigint, fps array<bigint>, size int, prefix array<bigint>, sketch array<bigint>")
    grouped = rows.groupBy("text_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("fps").alias("fps"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
    # a short key, which stays what it is once written
    classes = materialize(grouped.withColumn("key", F.monotonically_increasing_id()), "classes")
    marked = classes.select("key", F.explode(F.array_distinct("fps")).alias("fp"))
    heads = materialize(marked.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "heads")
    equal = marked.join(heads.where("n > 1").select("fp", "head"), "fp").select(F.col("key").alias("a"), F.col("head").alias("b"))
    # a pair meets in up to twenty tables
    close = hamming_links(heads.select("fp"), crowded).distinct()
    close = close.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst").select("a", "b")
    ordered = (F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    proposed = materialize(equal.unionByName(close).where("a <> b").select(*ordered).distinct(), "proposed")
    links = _verified(docs, classes, proposed, similar, words)

    shared, sketches = _entries(classes), classes.select("key", "sketch")
    entries = _open(shared, links, sketches)
    for turn in range(STARS):
        # one member stands for each component of a bucket, another one in each bucket; that of the most frequent component is the centre
        members = entries.where("n > 2").groupBy("shingle", "root").agg(F.count("*").alias("m"), F.min_by(F.struct("key", "size", "pos", "sketch"), F.xxhash64("key", "shingle", F.lit(turn))).alias("c"))
        centre = members.groupBy("shingle").agg(F.max_by(F.struct("c.*", "root"), F.struct("m", "root")).alias("c")).select("shingle", "c.*")
        pairs = entries.alias("a").join(centre.alias("b").hint("merge"), (F.col("a.shingle") == F.col("b.shingle")) & F.expr("a.root <> b.root") & _could_reach(similar))
        pairs = pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).select(*ordered).distinct()
        found = _verified(docs, classes, materialize(pairs, "stars"), similar, words)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        entries = _open(entries.select("shingle", "key", "size", "pos"), links, sketches)
    pairs = entries.alias("a").join(entries.alias("b").hint("merge"), F.expr("a.shingle = b.shingle and a.key < b.key and a.root <> b.root") & _could_reach(similar))
    pairs = materialize(pairs.select(F.col("a.key").alias("src"), F.col("b.key").alias("dst")).distinct(), "pairs")
    return classes.select("key", "text_key", "first_id", "n"), links.unionByName(_verified(docs, classes, pairs, similar, words))


def one_of_each(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each group of exact and near copies: that of the smallest doc_id.

    A row without id stays only if no copy has one. Empty texts are copies of
    each other. An empty table gives no rows.
    """
    classes, links = near_copy_links(docs, similar, words)
    placed = _with_roots(classes, materialize(links, "links"))
    keep = placed.groupBy("root").agg(F.min(F.struct("first_id", "text_key")).alias("k")).select(F.col("k.first_id").alias("_id"), F.col("k.text_key").alias("_kept"))
    # the row travels as one column, so its names meet none of those made here
    rows = _keyed(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")).select("_row", "_key", "_id")
    kept = rows.join(keep, "_id").where("_key = _kept").dropDuplicates(["_id", "_kept"])
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
