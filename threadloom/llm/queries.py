"""Registered queries of this package: ``opN_<name>`` on whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.storage import materialize


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.quality_rules import apply_rules, fit

    docs = _docs(spark, sf_dir)
    return apply_rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.license_scan import scan_licenses

    return scan_licenses(_docs(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.pii import span_digest

    return span_digest(_docs(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.language_id import fit, predict

    docs = _docs(spark, sf_dir)
    return predict(docs, fit(docs))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.simhash_dedup import near_duplicate_groups

    groups = near_duplicate_groups(_docs(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.toxicity import fit, score

    docs = _docs(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.decontaminate import find_leaks

    return find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.sharding import interleave

    placed = interleave(_docs(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.token_binary import token_files

    return token_files(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from threadloom.llm.byte_bpe import encode_digest

    return encode_digest(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.divergence import audit

    return audit(_docs(spark, sf_dir))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.html_extract import extract, fit

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(_docs(spark, sf_dir), pages))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from threadloom.llm.ranked_search import build_index, search

    index = materialize(build_index(_docs(spark, sf_dir)), "search-index")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_sharding": op8_sharding,
    "op9_token_binary": op9_token_binary,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_html_extract": op12_html_extract,
    "op13_ranked_search": op13_ranked_search,
}

#: Sharding in DuckDB, the checksum of the text's bytes included. The other operators learn, join by likeness or run libraries, which SQL can't express.
_SHARDING = """WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT doc_id, coalesce('1' || source, '0') AS stratum, coalesce(text, '') AS text FROM documents),
coded AS (SELECT doc_id, stratum, octet_length(encode(text)) + 16 AS size, hex(encode(text)) AS h FROM raw),
summed AS (SELECT doc_id, stratum, size, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8), 4294967295), 4294967295) AS crc FROM coded, tbl),
mixed AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || crc) AS mix FROM summed),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id, crc)::DOUBLE - CAST('0x' || substr(md5(stratum), 1, 8) AS BIGINT)::DOUBLE / 4294967296::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS place FROM mixed),
placed AS (SELECT *, row_number() OVER (ORDER BY place, stratum, doc_id, crc) - 1 AS position, count(*) OVER () AS total FROM ranked),
dealt AS (SELECT *, position * 40 // total AS shard FROM placed)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, shard, position - (shard * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIVERGENCE = rf"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN vocabulary v USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM vocabulary GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (v.n + 5)) // (g.lang_total + 5 * g.v) AS q
  FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
priced AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

#: Scoring every document for every item, without an index.
_SEARCH = rf"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT row, unnest(terms) AS term FROM docs),
counts AS (SELECT row, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM docs),
norms AS (SELECT row, doc_id, 50 + (50 * len(terms) * n) // l AS m FROM docs, size WHERE len(terms) > 0),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, size GROUP BY term, n),
asked AS (SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (SELECT item_id, text, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN norms USING (row) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored JOIN norms USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""

SQL: dict[str, str] = {"op8_sharding": _SHARDING, "op11_divergence_audit": _DIVERGENCE, "op13_ranked_search": _SEARCH}
