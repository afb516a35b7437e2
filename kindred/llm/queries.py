"""The queries of the corpus operators: each applies one operator to its whole table and derives the columns of its result."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import language, linedup, mixing, neardup, packing, quality, ranked, repair, setjoin, shards, suffix, tokens, topk
from kindred.session import shared_dir


def _vocabulary() -> str:
    """The tokenizer file with word ends, read by the driver; KINDRED_VOCABULARY names another."""
    if path := os.environ.get("KINDRED_VOCABULARY"):
        return path
    try:
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")
    except ImportError:
        return "/opt/tokenizers/word_bpe_49k.json"


#: Follows every document's own tokens.
END_ID = 2


def tokenizer_file() -> str:
    with open(_vocabulary(), encoding="utf-8") as f:
        return f.read()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.predict(docs, model, keep=(held_out.alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_documents(spark, sf_dir), _vocabulary())


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_file(), END_ID).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_report(_documents(spark, sf_dir), words_an_edit=linedup.WORDS_AN_EDIT)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20, 64).select("query_id", "rank", "vec_id", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The versions of the map are the operator's second result and stay.
    rows, _ = shards.shard(_documents(spark, sf_dir), 16, store=f"{shared_dir(spark).rstrip('/')}/slot-map-{uuid.uuid4().hex}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.joined(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_packing, op4_line_dedup, op5_exact_top_k, op6_quality_rules, op7_sharding, op8_source_mixing, op9_minhash_near_dedup, op10_suffix_array_dedup, op11_ranked_search, op12_conversation_repair, op13_ngram_jaccard_join)}


def _quality_sql() -> str:
    """The counts of repeated words and characters, spelled out n-gram by n-gram."""
    word = r"[^\x20\x09-\x0D]+"
    lengths = [3, *(n for n, _ in quality.NGRAM_LIMITS)]
    gram = lambda n: " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])
    grams = " UNION ALL ".join(f"SELECT r, i, {n} AS n, {gram(n)} AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)" for n in lengths)
    over = " OR ".join(f"coalesce(c{n}, 0) > {limit}::DOUBLE * word_chars" for n, limit in quality.NGRAM_LIMITS)
    pivot = ", ".join(f"sum(c) FILTER (n = {n}) AS c{n}" for n, _ in quality.NGRAM_LIMITS)
    return f"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
      l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, regexp_extract_all(t, '{word}') AS ws FROM d),
      w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
      g AS (SELECT * FROM ({grams}) WHERE g IS NOT NULL),
      many AS (SELECT r, n, g FROM g GROUP BY ALL HAVING count(*) > 1),
      covered AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM g SEMI JOIN many USING (r, n, g)),
      sums AS (SELECT r, count(*) FILTER (n = 3) AS n_repeat_words, {pivot} FROM (SELECT r, n, length(w) AS c FROM covered JOIN w USING (r, i)) GROUP BY r),
      seen AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM l)),
      dup AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_chars FROM seen WHERE nth > 1 GROUP BY r),
      c AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
          length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars,
          coalesce(n_repeat_words, 0) AS n_repeat_words, sums.* EXCLUDE (r, n_repeat_words)
        FROM d JOIN l USING (r) LEFT JOIN sums USING (r) LEFT JOIN dup USING (r)),
      b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
      SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
        NOT base_failed AND NOT ({over} OR dup_chars > {quality.MAX_DUP_LINE_CHARS}::DOUBLE * word_chars OR n_symbols > {quality.MAX_SYMBOLS_PER_WORD}::DOUBLE * n_words) AS kept FROM b"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": _quality_sql(),
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_conversation_repair": repair.sql(),
    "op13_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, CASE WHEN len(w) < {setjoin.SHINGLE} THEN array_to_string(w, ' ') ELSE {" || ' ' || ".join(f"w[i + {k}]" for k in range(setjoin.SHINGLE))} END AS g
              FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {setjoin.SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n u ON u.r = x JOIN n v ON v.r = y WHERE 100 * c >= {setjoin.PERCENT} * (u.n + v.n - c)),
        reach AS (SELECT r AS x, r AS y FROM n UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
        low AS (SELECT x, min(doc_id) AS low FROM reach JOIN d ON d.r = reach.y GROUP BY x)
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE low END AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN low ON low.x = d.r""",
    "op11_ranked_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{ranked.TERM}') AS ts FROM documents),
        c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
        p AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{ranked.TERM}')) AS t FROM benchmark),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
        s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
              FROM i JOIN w USING (t) JOIN p USING (t), c GROUP BY item_id, r, doc_id),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {ranked.TOP}""",
}
