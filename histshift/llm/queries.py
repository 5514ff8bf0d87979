"""The registered queries opN_<name> of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histshift.llm.common import table


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.substring_dedup import dedup_digest
    return dedup_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.secrets import secret_digest
    return secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.quality import classify
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.chat import chat_digest
    rows = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role",
                                     "'</s>[INST] ok [/INST]' AS text")
    return chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(rows))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.topk import top_k
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.warc import archive_digest
    return archive_digest(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.pieces import encode_digest
    return encode_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.fim import fim_digest
    return fim_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.mixing import mix_digest
    return mix_digest(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from histshift.llm.gnat import hard_negatives, shifted_labels
    return hard_negatives(shifted_labels(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")),
                          F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_exact_topk, op2_best_fit_packing, op3_one_bit_ann, op4_quality_classifier,
    op5_piece_nbest, op6_warc, op7_secret_scan, op8_chat_format,
    op9_substring_dedup, op10_jaccard_join, op11_fill_in_middle, op12_source_mix,
    op13_hard_negatives)}

#: The modules that the queries load when they run.
MODULES = ("ann", "chat", "fim", "gnat", "jaccard_join", "mixing", "packing", "pieces", "quality", "secrets",
           "substring_dedup", "topk", "warc")

#: Turn marks of the template, by length, as the formatter escapes them.
_MARKS = ("<</SYS>>", "[/INST]", "[/ROLE]", "<<SYS>>", "[INST]", "[ROLE]", "[TEXT]", "</s>", "<s>")


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for m in _MARKS:
        out = f"replace({out}, '{m}', '{m[0]}\\{m[1:]}')"
    return out


ORACLE: dict[str, str] = {"op8_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, coalesce(lag(r) OVER w, 'START') AS state, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY place)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x ELSE '' END, '' ORDER BY place), '')) AS loss_sha256,
  sum(length({_escaped('x')}) + CASE r WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length({_escaped('r')}) END)::BIGINT AS formatted_chars,
  bool_and(CASE state WHEN 'START' THEN r IN ('system', 'user') WHEN 'system' THEN r = 'user'
      WHEN 'user' THEN r = 'assistant' WHEN 'assistant' THEN r = 'user' ELSE false END
      AND (place < n OR r = 'assistant')) AS valid
FROM s GROUP BY conv_id""", "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
i AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x::DOUBLE)) AS e FROM v),
r AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
  FROM i q JOIN i c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""", "op6_warc": """
WITH p AS (
  SELECT page_id, url, sha1(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT
    AS payload_bytes FROM pages),
r AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS origin FROM p
  WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN origin END AS refers_to, true AS ok FROM r""", "op11_fill_in_middle": """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::UBIGINT AS h1,
    ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM h),
c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS lo,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS hi,
    x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') AS plain FROM u),
p AS (
  SELECT *, coalesce(list_aggregate(u[1:lo], 'string_agg', ''), '') AS a,
    coalesce(list_aggregate(u[lo + 1:hi], 'string_agg', ''), '') AS b,
    coalesce(list_aggregate(u[hi + 1:], 'string_agg', ''), '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(b) END::BIGINT AS middle_chars,
  sha256(CASE WHEN plain THEN x WHEN h4 % 100 < 50 THEN '<S>' || z || '<P>' || a || '<M>' || b
    ELSE '<P>' || a || '<S>' || z || '<M>' || b END) AS output_sha256,
  sha256(CASE WHEN plain THEN x ELSE a || b || z END) AS restored_sha256 FROM p""", "op12_source_mix": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('12:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
f AS (     -- sources by the share at which they are full; those before the first that is not stay full
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER z AS open, coalesce(sum(2 * source_size) OVER y, 0) AS given
  FROM s WINDOW z AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    y AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (     -- the share of weight 1, as a fraction
  SELECT (3 * total - 2 * given)::BIGINT AS num, (2 * open)::BIGINT AS den FROM f
  WHERE 2 * source_size * 2 * open > w * (3 * total - 2 * given) ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN 2 * source_size * den <= w * num THEN 2 * source_size ELSE w * num END::BIGINT AS num,
    CASE WHEN 2 * source_size * den <= w * num THEN 1 ELSE den END::BIGINT AS den FROM s LEFT JOIN l ON true),
b AS (
  SELECT source, source_size, coalesce(num::DOUBLE / den, 0) AS target, coalesce(num // den, 0) AS budget FROM t),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
    + least(size, greatest(0, budget % source_size - before)) END::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source""", "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, 'e': embedding}) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
i AS (SELECT vec_id, r.label AS label, list_transform(r.e, lambda x: floor(256 * x::DOUBLE)) AS e FROM v),
p AS (
  SELECT a.vec_id AS anchor_id, a.label, a.e, c.vec_id AS positive_id, list_inner_product(a.e, c.e)::BIGINT AS positive_score
  FROM i a JOIN i c ON a.vec_id % 50 = 0 AND a.label = c.label AND a.vec_id <> c.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, c.vec_id) <= 5),
n AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS negative_id, list_inner_product(a.e, c.e)::BIGINT AS negative_score
  FROM i a JOIN i c ON a.vec_id % 50 = 0 AND a.label <> c.label)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER
    AS rank, negative_id, positive_score, negative_score
FROM p JOIN n USING (anchor_id)
WHERE 50 * positive_score <= 100 * negative_score AND 100 * negative_score <= 95 * positive_score
QUALIFY rank <= 3"""}
