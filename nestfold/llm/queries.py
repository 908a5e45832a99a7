"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, embedding_join, ngram_join, secret_scan, spelling, token_blocks, topk, toxicity, url_cascade, vector_codes, warc
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query("op3_token_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op5_bpe_codec")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query("op7_embedding_range_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.embedding_range_join(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The rules of the URL query: fixed values.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP9_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, row_number() OVER () AS rn,
         CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rn, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut)
SELECT page_id, host, path, rh || rp AS rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY rn ORDER BY length(rh || rp) DESC NULLS LAST) = 1
"""


@query("op9_url_cascade", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


@query("op2_warc_archive", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) x(a, b, c, d))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|start|>' || role || '<|sep|><|end|>')
           + length(regexp_replace(regexp_replace(text, '(<)(\\*)(/?s>|\|(?:start|sep|end|image|audio|document|im_start|im_end|endoftext)\|>)', '\1\\\2\3', 'g'),
                                   '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op4_chat_format", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.formatted_chats(own.union(more))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents"), model)


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum of "<id>:<run>" by its table of 256 words; near words share a word with one letter deleted.
OP11_SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS tagged, run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
sums AS MATERIALIZED (
  SELECT run, times,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(tagged)), lambda i: ('0x' || substr(hex(encode(tagged)), 1 + 2 * i, 2))::BIGINT)),
                                     lambda c, b: xor(t[1 + xor(c & 255, b)], c >> 8))) AS h
  FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.shorter = b.shorter AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.shorter = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.shorter = w.word),
around AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best
  FROM pairs JOIN words ON b = word GROUP BY a),
judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM words LEFT JOIN around USING (word)),
chain AS (
  SELECT word, word AS root, form FROM judged
  UNION ALL SELECT c.word, j.word, j.form FROM chain c JOIN judged j ON c.form = j.word)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON j.word = c.word AND c.form IS NULL
"""


@query("op11_spelling_forms", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


def _op12_sql(rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""far{r} AS (
  SELECT x.row, x.part, b.entry, sum((x.v - b.c) * (x.v - b.c))::BIGINT AS far FROM x JOIN book{r} b USING (part, pos) GROUP BY ALL),
took{r} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM far{r} GROUP BY row, part)"""
        )
        if r < rounds:
            steps.append(
                f"""sums{r} AS (
  SELECT part, pos, entry, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN took{r} USING (row, part) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT part, pos, entry, CASE WHEN s IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{r} LEFT JOIN sums{r} USING (part, pos, entry))"""
            )
    return f"""
WITH ints AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (
  SELECT row, (i - 1) // (len(ints) // 4) AS part, (i - 1) % (len(ints) // 4) AS pos, ints[i] AS v
  FROM (SELECT row, ints, unnest(range(1, len(ints) + 1)) AS i FROM ints)),
book0 AS MATERIALIZED (SELECT part, pos, row - 1 AS entry, v AS c FROM x WHERE row <= 256),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, code, error FROM ints JOIN
    (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM took{rounds} GROUP BY row) USING (row))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


@query("op12_vector_codes", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH ints AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, i, ints[i] AS v FROM (SELECT vec_id, ints, unnest(range(1, len(ints) + 1)) AS i FROM ints)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score
  FROM x q JOIN x c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


@query("op13_top_inner_products", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)
