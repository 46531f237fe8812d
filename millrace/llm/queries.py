"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.base import table

QUERIES = {}
ORACLE = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.mixing import mix, n_words

    docs = table(spark, sf_dir, "documents")
    found = mix(docs.select(F.col("doc_id").alias("id"), "source", n_words().alias("size")))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (g ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@_query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.chat import digest, examples

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return digest(examples(turns.unionByName(extra)))


def _sql_escaped(x: str) -> str:
    from millrace.llm.chat import CONTROL

    x = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return x


ORACLE["op8_chat_formatting"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, 24 + length(replace({_sql_escaped('role')}, chr(10), '<|nl|>')) + length({_sql_escaped('said')}) AS size, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said)),
e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS stop FROM n),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(said, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(stop) FILTER (WHERE role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from millrace.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from millrace.llm.base import shared_dir
    from millrace.llm.token_files import read_token_files, write_token_files

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, folder)


@_query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.substring import dedup_substrings, digest

    return digest(dedup_substrings(table(spark, sf_dir, "documents"), window=13))


ORACLE["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM p),
c AS (SELECT DISTINCT doc_id, j FROM m, unnest(range(i, i + 13)) AS v(j) WHERE first < doc_id),
s AS (SELECT d.doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS v(j)),
k AS (SELECT s.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY s.j) FILTER (WHERE c.j IS NULL) AS kept FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.j = s.j GROUP BY s.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLE["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM e JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * e.c >= 85 * (p.n + q.n - e.c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""


@_query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
