"""The queries opN_: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.decontaminate import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.substring import substring_report

    out = substring_report(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.media import UNIT, features, store

    read = features(store(_documents(spark, sf_dir)))
    size = F.octet_length("payload").cast("long")
    tail = F.substring(F.col("payload"), -32, 32)
    return read.select("doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.lower(F.hex("hash")).alias("feature"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.warc import archive

    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:

    return packed_digest(_documents(spark, sf_dir))


def packed_digest(docs: DataFrame) -> DataFrame:
    from larkspur.llm.packing import pack_documents

    crc = F.crc32("ids").alias("ids_crc32")
    few = lambda df: df.select("doc_id", "start", "length", F.when(F.col("open"), F.col("ids")).alias("ids"), crc, "doc_tokens", "sequence_id", "offset", "part", "open")
    pieces = pack_documents(docs, _vocabulary("byte_bpe_50k.json"), project=few)
    return pieces.select("doc_id", "start", "length", F.coalesce("ids_crc32", F.crc32("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.bitpack import token_files

    read = token_files(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.sharding import shard_documents

    return shard_documents(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.unigram import token_counts

    return token_counts(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.common import Scratch
    from larkspur.llm.trie import numbered, prefix_trie, regrafted, turn_rows

    scratch, c = Scratch(spark), F.col("conv_id")
    turns = scratch.stage(numbered(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet")), scratch), "numbered")
    rebuilt, conversations = regrafted(turns, c - c % 20, F.crc32(c.cast("string")) % 4, scratch, most=3)
    out = prefix_trie(rebuilt, conversations)
    scratch.drop()
    return out


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.exact import exact_duplicates

    return exact_duplicates(_documents(spark, sf_dir), keep="largest")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_media, op4_packing, op5_token_files, op6_warc, op7_sharding, op8_toxicity, op9_token_counts, op10_simhash, op11_prefix_trie, op12_exact_dedup, op13_whitening)}

_MARKS = "\x01\x02\x03"


def _tokens_sql(text: str, raw: bool) -> str:
    """decontaminate.raw_tokens or template in RE2, which has no look-around: a replacement that may overlap is done twice."""
    from larkspur.llm.decontaminate import NAME, NUMBER, UNIT, UNITS

    s = f"translate(coalesce({text}, ''), '{_MARKS}', '   ')"
    for pattern, by in [(r"([0-9])[.,:/]([0-9])", r"\1d\2")] * 2 + [(r"([\p{L}\p{N},;] )(\p{Lu}\p{Ll})", rf"\1{NAME}\2")] * 2 + [(r"(^|[^\p{L}\p{N}])([0-9]+(?:d[0-9]+)*)", rf"\1 {NUMBER}\2 "), (rf"(?i)({NUMBER}\S+\s+)({UNITS})($|[^\p{{L}}\p{{N}}])", rf"\1{UNIT}\2\3")]:
        s = f"regexp_replace({s}, '{pattern}', '{by}', 'g')"
    s = f"lower({s})"
    s = f"replace({s}, '{UNIT}%', '{UNIT}pct')" if raw else f"regexp_replace({s}, '([{_MARKS}])(?:[\\p{{L}}\\p{{N}}]+|%)', '\\1', 'g')"
    return f"list_filter(string_split_regex({s}, '[^\\p{{L}}\\p{{N}}{_MARKS}]+'), lambda x: x <> '')"


def _leaks_sql() -> str:
    slot = f"list_filter({{0}}, lambda x: regexp_matches(x, '^[{_MARKS}]'))"
    return f"""
WITH items AS (SELECT DISTINCT item_id, {_tokens_sql("text", False)} AS t, {_tokens_sql("text", True)} AS r FROM benchmark),
long AS (SELECT *, least(len(t), 8) AS size FROM items WHERE len(t) >= 3),
iw0 AS (SELECT item_id, size, i - 1 AS spot, t[i:i + size - 1] AS w, {slot.format("r[i:i + size - 1]")} AS slots FROM (SELECT *, unnest(range(1, len(t) - size + 2)) AS i FROM long)),
iw AS (SELECT *, count(DISTINCT spot) OVER (PARTITION BY item_id) AS windows FROM iw0 WHERE 2 * len(slots) <= size),
docs AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT doc_id, {_tokens_sql("text", False)} AS t, {_tokens_sql("text", True)} AS r, text FROM documents)),
dw AS (SELECT k, doc_id, size, i - 1 AS pos, t[i:i + size - 1] AS w, r[i:i + size - 1] AS v FROM (SELECT k, doc_id, t, r, size, unnest(range(1, len(t) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM iw))),
hits AS (SELECT k, doc_id, item_id, pos, spot, size, windows, slots, pos - spot AS shift, {slot.format("v")} AS own FROM dw JOIN iw USING (w, size)),
pairs AS (SELECT DISTINCT k, item_id, shift, unnest(slots) AS a, unnest(own) AS b FROM hits WHERE len(slots) > 0),
fine AS (SELECT k, item_id, shift, count(*) FILTER (WHERE a <> b) AS changed FROM pairs GROUP BY 1, 2, 3 HAVING count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b)),
found AS (SELECT k, doc_id, item_id, spot, windows, 0 AS changed FROM hits WHERE len(slots) = 0 UNION ALL SELECT k, doc_id, item_id, spot, windows, changed FROM hits JOIN fine USING (k, item_id, shift) WHERE len(slots) > 0)
SELECT doc_id, item_id, count(DISTINCT spot) AS n_windows, round(count(DISTINCT spot) / max(windows)::DOUBLE, 6) AS coverage, max(changed)::BIGINT AS n_changed
FROM found GROUP BY k, doc_id, item_id HAVING count(DISTINCT spot) >= least(max(windows), 3) AND count(DISTINCT spot) >= 0.2 * max(windows)
"""


ORACLE_SQL = {
    "op1_decontamination": _leaks_sql(),
    "op2_substring_dedup": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
spans AS (SELECT d.r, s.i, array_to_string(d.w[s.i:s.i + 34], ' ') AS span FROM docs d, LATERAL (SELECT unnest(range(1, len(d.w) - 33)) AS i) s),
twice AS (SELECT r, i FROM spans WHERE span IN (SELECT span FROM spans GROUP BY span HAVING count(*) > 1)),
marks AS (SELECT w.r, w.i, w.word, max(t.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS hit FROM words w LEFT JOIN twice t ON w.r = t.r AND w.i = t.i),
kept AS (SELECT r, count(*) FILTER (WHERE hit IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE hit IS NULL) AS kept FROM marks GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.r = k.r
""",
    "op12_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, k * 5 + 1, 5))::BIGINT) >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
""",
}
