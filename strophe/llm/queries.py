"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import chat, line_dedup, merkle, ngram_join, packing, pii, quality, sentencepieces, sharding, token_files, topk, toxicity, vector_codes
from strophe.llm.common import documents, fresh_dir, unsigned_crc32


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies (five words, similarity 0.8) and its number of links."""
    return ngram_join.join(documents(spark, sf_dir), 5, 0.8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces and packed into sequences of 2048 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2048, 1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows that are not held out."""
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that near copies elsewhere repeat."""
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines_removed", "text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base measures and the cascade's verdict."""
    out = quality.assess(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all other vectors."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5, 256)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and whether they decode to it."""
    return sentencepieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False, decoded=True)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as token files and read back from them."""
    return token_files.write_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, keep_ids=False)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight and its place there, in uniformly random order."""
    out, text = sharding.shuffle(documents(spark, sf_dir), 8), F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), unsigned_crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof up to the root, and whether it holds after a third was tampered with."""
    return merkle.check_documents(documents(spark, sf_dir), fresh_dir(spark, "manifest"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of four bytes and its error, with codebooks fitted in four rounds."""
    return vector_codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_toxicity, op4_line_dedup, op5_pii, op6_quality_rules, op7_topk_search, op8_sentencepiece, op9_token_files, op10_chat_formatting, op11_sharding, op12_merkle_manifest, op13_vector_codes)}


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "lower(coalesce(text, ''))")} AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
r AS (WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT d.doc_id::BIGINT AS doc_id, r.b::BIGINT AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links
FROM d JOIN r ON r.a = d.doc_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, t, w, lines, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id::BIGINT AS doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed
            OR n_symbols > 0.1 * n_words
            OR word_chars > 20 * n_words
            OR word_chars < 2 * n_words
            OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 0.6 * n_words
            OR len(regexp_extract_all(t, '\p{{Lu}}')) > 0.5 * len(regexp_extract_all(t, '\p{{L}}'))
            OR len(regexp_extract_all(t, '(?:…|\.\.\.)[\x20\x09-\x0D]*(?:\n|$)')) > greatest(3, 0.3 * len(string_split(t, chr(10))))
            OR n_dup_lines > 0.5 * len(lines)) AS kept
FROM b
"""


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank::INTEGER AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
                  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said FROM conversations),
p AS (SELECT conv_id, place, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY place) AS text, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
whole AS (SELECT conv_id, n_turns, text FROM p WHERE place = n_turns)
SELECT min(conv_id)::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, text
FROM whole WHERE (text, n_turns) NOT IN (SELECT (text, place) FROM p WHERE place < n_turns) GROUP BY n_turns, text
"""

FIELDS = ("doc_id", "source", "lang", "n_chars")
FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
LOWER_SQL = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
#: CRC-32 bit by bit, over the digits of a number.
CRC_SQL = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b:
    list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)), 4294967295), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, sha256({" || ".join(FIELD_SQL.format(c) for c in (*FIELDS, "text"))}) AS leaf, sha256({" || ".join(FIELD_SQL.format(c) for c in (*FIELDS, LOWER_SQL))}) AS changed FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, CASE WHEN {CRC_SQL} % 3 = 0 THEN changed ELSE leaf END AS given FROM leaves),
up AS (SELECT tree, 0 AS level, rank, n, leaf AS digest FROM placed
    UNION ALL SELECT tree, level + 1, rank // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY rank)) FROM up WHERE n > 1 GROUP BY tree, level, n, rank // 8),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, tree AS rank, n, digest FROM subroots
    UNION ALL SELECT level + 1, rank // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY rank)) FROM top WHERE n > 1 GROUP BY level, n, rank // 8),
nodes AS (SELECT tree, level, rank, n, digest FROM up WHERE n > 1 UNION ALL SELECT t.tree, 100 + level, rank, n, digest FROM top, (SELECT DISTINCT tree FROM subroots) t WHERE n > 1),
steps AS MATERIALIZED (SELECT p.tree, p.rank AS leaf_rank, x.level, x.rank, x.digest, x.rank = own.r AS mine, dense_rank() OVER (PARTITION BY p.tree, p.rank ORDER BY x.level) AS step
    FROM placed p, (SELECT DISTINCT tree, level FROM nodes) l, (SELECT 0) z,
         LATERAL (SELECT CASE WHEN l.level < 100 THEN p.rank // (8 ** l.level)::BIGINT ELSE p.tree // (8 ** (l.level - 100))::BIGINT END AS r) own, nodes x
    WHERE l.tree = p.tree AND x.tree = p.tree AND x.level = l.level AND x.rank // 8 = own.r // 8),
proofs AS (SELECT tree, leaf_rank, string_agg(digest, '' ORDER BY level, rank) AS proof FROM steps WHERE NOT mine GROUP BY ALL),
fold AS (SELECT tree, rank AS leaf_rank, 0 AS step, given AS acc FROM placed
    UNION ALL SELECT f.tree, f.leaf_rank, f.step + 1, sha256(string_agg(CASE WHEN s.mine THEN f.acc ELSE s.digest END, '' ORDER BY s.rank))
    FROM fold f JOIN steps s ON s.tree = f.tree AND s.leaf_rank = f.leaf_rank AND s.step = f.step + 1 GROUP BY f.tree, f.leaf_rank, f.step),
folded AS (SELECT tree, leaf_rank, arg_max(acc, step) AS folded_root FROM fold GROUP BY ALL)
SELECT p.doc_id::BIGINT AS doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(f.proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folded d ON d.tree = p.tree AND d.leaf_rank = p.rank LEFT JOIN proofs f ON f.tree = p.tree AND f.leaf_rank = p.rank, (SELECT digest FROM top WHERE n = 1) r
"""


def _op13_sql(rounds: int = 4) -> str:
    """Each round assigns parts to the nearest entry of the codebook before and takes floored means."""
    assign = """a{0} AS MATERIALIZED (SELECT vec_id, part, v, m % 256 AS entry, m // 256 AS error FROM (SELECT p.vec_id, p.part, any_value(p.v) AS v,
        min(256 * list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + c.entry) AS m FROM parts p JOIN c{0} c USING (part) GROUP BY p.vec_id, p.part))"""
    means = """c{1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{0} c LEFT JOIN
        (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY d) AS v FROM (SELECT part, entry, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{0}) GROUP BY ALL) GROUP BY part, entry) m
        ON m.part = c.part AND m.entry = c.entry)"""
    steps = [s for r in range(rounds) for s in (assign.format(r), means.format(r, r + 1))] + [assign.format(rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(p)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{",".join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN kept USING (vec_id) GROUP BY label)
SELECT e.vec_id::BIGINT AS vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN kept USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM kept.label
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op6_quality_rules": OP6_SQL, "op7_topk_search": OP7_SQL, "op10_chat_formatting": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_vector_codes": _op13_sql()}
