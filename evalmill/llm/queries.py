"""One query for each operator over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm import (
    chat_format,
    divergence,
    exact_dedup,
    html_extract,
    language_id,
    ngram_lm,
    packing,
    sentencepiece_codec,
    sharding,
    simhash,
    topk,
    toxicity,
    vector_codes,
)
from evalmill.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.backoff_scores(_table(spark, sf_dir, "documents")).drop("mean_log10")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_codec.encoded_digests(docs, _tokenizer("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup.digest_report(docs, exact_dedup.scratch_index(spark))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learned_from(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        (language_id.fold() == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, _tokenizer("word_bpe_49k.json")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learned_from(docs))
    return found.select("doc_id", (language_id.fold() == 2).alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    sample = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(sample)
    formatted = chat_format.format_conversations(turns)
    read = formatted.select(
        F.col("tree").alias("conv_id"),
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded_with_label_errors(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least_docs=10, top_terms=10)


def _escaped_sql(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '{chat_format.ESC}', '{chat_format.ESC}e')"
    for control in chat_format.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}{chat_format.ESC}c{control[1:]}')"
    return out


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat_format.OPEN) + len(chat_format.CLOSE) + 2} + length({_escaped_sql("role")})
                + length({_escaped_sql("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP1_SQL = """
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split),
gram AS (
  SELECT doc_id, i, w[i] AS g1,
         CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3
  FROM place),
rest AS (SELECT doc_id, (SELECT count(*) FROM gram) - len(w) AS words, len(w) AS n_words FROM split),
other AS (
  SELECT doc_id, i, least(i, 3) AS longest,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
         CASE WHEN g2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) END AS c2,
         CASE WHEN g3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) END AS c3
  FROM gram),
history AS (
  SELECT *, lag(c1) OVER words AS h1, lag(c2) OVER words AS h2 FROM other WINDOW words AS (PARTITION BY doc_id ORDER BY i)),
scored AS (
  SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS level,
         CAST(round(log10(
           CASE WHEN c3 > 0 THEN c3 / h2 WHEN c2 > 0 THEN c2 / h1 * pow(0.4, longest - 2)
                ELSE greatest(c1, 1) / (words + 1) * pow(0.4, longest - 1) END) * 1000000) AS BIGINT) AS micro
  FROM history JOIN rest USING (doc_id))
SELECT r.doc_id, any_value(r.n_words) AS n_words, CAST(coalesce(sum(micro), 0) AS BIGINT) AS score_micro,
       count(*) FILTER (level = 1) AS hits_1, count(*) FILTER (level = 2) AS hits_2, count(*) FILTER (level = 3) AS hits_3
FROM rest r LEFT JOIN scored USING (doc_id) GROUP BY r.doc_id
"""

OP10_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM scored WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
occurs AS (
  SELECT doc, lang, source, term, count(*) AS n
  FROM (SELECT doc, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM occurs GROUP BY ALL HAVING count(*) >= 10),
counts AS MATERIALIZED (SELECT lang, source, term, CAST(sum(o.n) AS HUGEINT) AS n FROM occurs o JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS BIGINT) AS p,
         CAST(1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS BIGINT) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER best AS INTEGER) AS rank
FROM found WINDOW best AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER best <= 10
"""


def _lloyd_sql(rounds: int) -> str:
    """Every round compares each part with each entry."""
    near = """near{n} AS MATERIALIZED (
  SELECT vec, p, any_value(x) AS x, min({{'d': d, 'e': entry}}) AS best
  FROM (SELECT vec, p, x, entry,
               list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM piece JOIN book{n} USING (p))
  GROUP BY vec, p)"""
    book = """book{m} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.c, b.c) AS c
  FROM book{n} b LEFT JOIN (
    SELECT p, entry, list(mean ORDER BY i) AS c
    FROM (SELECT p, best.e AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS mean
          FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM near{n}) GROUP BY p, best.e, i)
    GROUP BY p, entry) m USING (p, entry))"""
    steps = [near.format(n=0)]
    for n in range(rounds):
        steps += [book.format(n=n, m=n + 1), near.format(n=n + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS vec, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (
  SELECT vec, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x
  FROM (SELECT vec, v, unnest(range(16)) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, vec - 1 AS entry, x AS c FROM piece WHERE vec <= 64),
{", ".join(steps)},
coded AS (
  SELECT vec, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec),
books AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256
  FROM (SELECT p, entry, unnest(c) AS c, unnest(range(len(c))) AS i FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (vec) CROSS JOIN books
"""


_QUERIES: dict[str, Query] = {
    "op1_backoff_scores": op1_backoff_scores,
    "op2_html_extraction": op2_html_extraction,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_exact_topk": op10_exact_topk,
    "op11_ring_sharding": op11_ring_sharding,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
}


def queries() -> dict[str, Query]:
    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_backoff_scores": OP1_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op9_chat_format": OP9_SQL,
        "op10_exact_topk": OP10_SQL,
        "op12_vector_codes": _lloyd_sql(2),
        "op13_source_divergence": OP13_SQL,
    }
