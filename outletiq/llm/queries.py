"""One registered query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletiq.llm import (ann, chunk_bpe, conversation_repair, importance, inner_product, lang_id, line_dedup, packing,
                          quality_rules, records, simhash, substring_dedup, toxicity)
from outletiq.llm.common import documents, save

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
END_OF_TEXT = 2
PACK_TOKENS, PACK_END = 2048, 0
LINE_RATIO, LINE_PAGES = 0.05, 5


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(documents(spark, sf_dir), tokenizer_file(BYTE_BPE), END_OF_TEXT)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), n=3, d=2)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(documents(spark, sf_dir), window=13)


def op4_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_and_decode(documents(spark, sf_dir), tokenizer_file(WORD_BPE))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.learn_and_score(documents(spark, sf_dir), labels)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.learn_and_predict(documents(spark, sf_dir))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file(WORD_BPE), PACK_END, PACK_TOKENS)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(documents(spark, sf_dir), LINE_RATIO, LINE_PAGES)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return save(conversation_repair.damaged_report(rows), "repaired")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = importance.resample(documents(spark, sf_dir), target, percent=25, least_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return inner_product.search(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chunk_bpe": op4_chunk_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_exact_top_k": op13_exact_top_k,
}

#: CRC-32 in SQL: the table of one byte's steps, and the checksum of a text's UTF-8 bytes.
CRC_TABLE = """SELECT list(list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i)
              ORDER BY i) AS tab FROM range(256) AS t(i)"""


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    steps = f"list_transform(range(octet_length(encode({text}))), lambda k: {byte})"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _edits(state: int) -> str:
    """Cheapest edits from here if this row is not preceded by an insertion: cost, letters, repaired lines."""
    initial, kept = {0: ("'s', 'u'", "CASE WHEN ini = 's' THEN s1 ELSE s2 END"), 1: ("'u'", "s2"), 2: ("'a'", "s3"),
                     3: ("'u'", "s2")}[state]
    to, name = (3, "assistant") if state == 2 else (2, "user")
    return f"""list_min([
      {{'c': s{state}.c + 4, 'a': 'D' || s{state}.a, 't': s{state}.t}},
      CASE WHEN fault IN (0, 3) AND ini IN ({initial}) THEN
        {{'c': ({kept}).c + fault, 'a': 'K' || ({kept}).a, 't': role || ':' || text || chr(10) || ({kept}).t}} END,
      CASE WHEN fault IN (0, 3) THEN
        {{'c': s{to}.c + 3 + fault, 'a': 'R' || s{to}.a, 't': '{name}:' || text || chr(10) || s{to}.t}} END])"""


def _inserted(name: str, state: str) -> str:
    return f"{{'c': {state}.c + 3, 'a': 'I' || {state}.a, 't': '{name}:' || chr(10) || {state}.t}}"


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op6_quality_rules": r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM base)),
windows AS (
  SELECT doc_id, pos, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
repeated AS (
  SELECT doc_id, pos FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)),
counted AS (
  SELECT * EXCLUDE (lines), len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM measured),
failures AS (
  SELECT source, unnest(['short', 'repetition', 'symbols', 'lines', 'word_length']) AS rule,
         unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
                 10 * n_dup_lines > 3 * n_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS failed
  FROM counted),
hosts AS (SELECT source, rule, count(*) AS docs, count(*) FILTER (WHERE failed) AS fails FROM failures GROUP BY ALL),
moments AS (
  SELECT rule, count(*) - 1 AS apart, sum(docs)::DOUBLE AS n, sum(fails)::DOUBLE AS f, sum(docs::DOUBLE * docs) AS squares,
         sum(fails::DOUBLE * fails / docs) AS s
  FROM hosts GROUP BY rule),
priors AS (
  SELECT rule, f / n AS m, CASE WHEN f > 0 AND f < n AND n - squares / n - apart > 0
         THEN ((s - f * f / n) / (f / n * (1 - f / n)) - apart) / (n - squares / n - apart) ELSE 0 END AS rho
  FROM moments),
verdicts AS (
  SELECT source, max(CASE WHEN rho <= 0 THEN m WHEN rho >= 1 THEN fails / docs
                          ELSE (fails + m * (1 - rho) / rho) / (docs + (1 - rho) / rho) END) <= 0.5 AS host_kept
  FROM hosts JOIN priors USING (rule) GROUP BY source)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND v.host_kept AS kept
FROM counted c JOIN verdicts v ON c.source IS NOT DISTINCT FROM v.source
""",
    "op10_line_dedup": f"""
WITH numbered AS (SELECT row_number() OVER () AS page, * FROM documents),
lines AS (
  SELECT page, source, text, pos, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT page, source, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM numbered WHERE text IS NOT NULL)),
pages AS (SELECT source, k, count(DISTINCT page) AS pages FROM lines WHERE k <> '' GROUP BY ALL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL),
boiler AS (
  SELECT p.source, p.k FROM pages p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
  WHERE p.pages >= {LINE_PAGES} AND p.pages > {LINE_RATIO} * t.total),
cut AS (
  SELECT l.page, count(*) AS n_lines, count(b.k) AS n_dropped,
         string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.k IS NULL) AS kept
  FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k GROUP BY l.page)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.kept, '') END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM numbered d LEFT JOIN cut c USING (page)
""",
    "op11_conversation_repair": f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
  FROM conversations, crc),
rows AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS again
  FROM hit WHERE d <> 0),
placed AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER o AS pos, row_number() OVER same AS seen,
         lag(left(role, 1)) OVER o AS before
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again),
    same AS (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0,
         {{'c': 6::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s1,
         {{'c': 3::BIGINT, 'a': 'I', 't': 'assistant:' || chr(10)}} AS s2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, pos - 1, list_min([b0, {_inserted("user", "b2")}, {_inserted("user", f"({_inserted('assistant', 'b3')})")}]),
         list_min([b1, {_inserted("user", "b2")}, {_inserted("user", f"({_inserted('assistant', 'b3')})")}]),
         list_min([b2, {_inserted("assistant", "b3")}]), list_min([b3, {_inserted("user", "b2")}])
  FROM (SELECT w.conv_id, w.pos, {_edits(0)} AS b0, {_edits(1)} AS b1, {_edits(2)} AS b2, {_edits(3)} AS b3
        FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.pos))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.s0.c, 0) AS cost,
       coalesce(w.s0.a, '') AS audit,
       sha256(coalesce(left(w.s0.t, greatest(length(w.s0.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.pos = 0
""",
    "op12_importance_resampling": f"""
WITH crc AS ({CRC_TABLE}),
texts AS (
  SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
split AS (
  SELECT target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
features AS (
  SELECT target, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM split),
hashed AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc),
counts AS (
  SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t
  FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS gain
  FROM counts),
weights AS (
  SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight, count(*) AS n_features
  FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 8))::BIGINT + 0.5)::DOUBLE
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split d LEFT JOIN weights e ON d.doc_id IS NOT DISTINCT FROM e.doc_id WHERE NOT target),
ordered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ordered o ON s.doc_id = o.doc_id
""",
    "op13_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id)::INT AS rank,
       b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
QUALIFY rank <= 5
""",
}
