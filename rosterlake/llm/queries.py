"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, common, compaction, dedup, htmlmain, importance, negatives, packing, quality, seekable, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(_table(spark, sf_dir, "documents"), end_id=0, max_tokens=2048)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, packing.Capacity(tokens=2048))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "tokens")
    seekable.write_tokens(_table(spark, sf_dir, "documents"), folder, end_id=2)
    return seekable.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Arrivals that the table comes in.  Of the shards of this many equal arrivals one tier
#: holds four at least, even if they lie on both sides of a tier's edge.
ARRIVALS = 8


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.ShardStore(spark, common.scratch(spark, "shards"))
    rows = _table(spark, sf_dir, "documents")
    store.append_each(rows, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.char_length(text).cast("bigint").alias("text_chars"), F.sha2(text, 256).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(length(coalesce(text, '')) AS BIGINT) AS text_chars,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

#: The contract's conversation of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _escaped_chars(column: str) -> str:
    """SQL for the length of an escaped text: each backslash and each control
    string adds one character."""
    added = [rf"length({column}) - length(replace({column}, '\', ''))"]
    added += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in chat.Template().controls]
    return f"length({column}) + " + " + ".join(f"({a})" for a in added)


_MARKS = sum(len(c) for c in chat.Template().controls[:3])
OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum({_MARKS} + {_escaped_chars("role")} + {_escaped_chars("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP7_SQL = r"""
WITH marks AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS place
  FROM marks)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM best
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, search=simhash.Search(bits=64, radius=2))
    digits = F.lower(F.hex("fp"))  # the lowest byte first
    return found.select("doc_id", F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(8))]).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (~quality.may_learn(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=5)


#: CRC-32 is spelt out: the table of its steps, and a fold over the bytes of a feature.
OP11_SQL = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
texts AS (SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT kind, doc_id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM words),
counted AS (SELECT kind, doc_id, feature, count(*) AS n FROM (SELECT kind, doc_id, unnest(f) AS feature FROM runs) GROUP BY ALL),
bytes AS (SELECT feature, list_transform(range(strlen(feature)), lambda i: CAST('0x' || substr(hex(feature), 2 * i + 1, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT feature FROM counted)),
known AS (SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(step[xor(c, x) % 256 + 1], c >> 8))) % 10000 AS bucket FROM bytes, steps),
sums AS (SELECT bucket, sum(CASE kind WHEN 'd' THEN n ELSE 0 END) AS s, sum(CASE kind WHEN 'b' THEN n ELSE 0 END) AS t FROM counted JOIN known USING (feature) GROUP BY bucket),
totals AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM sums),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM sums, totals),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN known USING (feature) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
scored AS (SELECT r.doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || r.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM runs r LEFT JOIN weights w ON w.doc_id = r.doc_id WHERE r.kind = 'd'),
placed AS (SELECT *, n_words >= 20 AS fits, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN fits AND place <= many * 5 // 100 THEN place END AS rank FROM placed
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same),
pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM starts),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM repeated) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM texts),
cut AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(places) AS p FROM gone)),
stay AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM each ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN gone USING (doc_id) LEFT JOIN stay USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_best_fit_packing, op2_token_files, op3_sharding, op4_chat_formatting, op5_nearest_neighbours, op6_bpe, op7_exact_dedup, op8_html_extraction, op9_simhash, op10_quality, op11_importance_resampling, op12_hard_negatives, op13_substring_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_substring_dedup": OP13_SQL}
