"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_search, chat_format, language_id, line_dedup, ngram_join, packing, quality, ranked_search, sentencepiece_viterbi, substring_dedup, suffix_dedup, topk_search, whitening
from .common import read_table, write_scratch


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    read = chat_format.parse_chats(chat_format.format_chats(turns.unionByName(extra)))
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turn_text, 256).alias("turns_sha256"), F.length(loss_text).cast("bigint").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "quality")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.top_inner_products(rows, rows.where("vec_id % 20 = 0"), k=20)


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_search.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.kept_digest(suffix_dedup.remove_repeats(docs))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.fuzzy_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = write_scratch(quality.document_statistics(read_table(spark, sf_dir, "documents")), "quality")
    model = quality.fit(stats, training_labels(read_table(spark, sf_dir, "labels")))
    scored = quality.score_statistics(stats, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_viterbi.PieceModel.read()
    encoded = sentencepiece_viterbi.encode(read_table(spark, sf_dir, "documents"), model)
    read = sentencepiece_viterbi.decode(encoded, model)
    return read.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("bigint").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.best_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language_id.fit(docs.where(~held_out).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model, error = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(v / model.trace)) for v in model.values[:4]), F.lit(0.0)), F.col("i") + 1)
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


SQL: dict[str, str] = {}

SQL["op2_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["op3_suffix_dedup"] = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT doc_id, unnest(range(len(x) // 2)) AS i, unnest(list_transform(range(len(x) // 2), lambda i: substr(x, (2 * i + 1)::BIGINT, 100))) AS s FROM h),
l AS (SELECT doc_id, i, substr(s, 1, 2) AS c, len(s) = 100 AND min(doc_id) OVER (PARTITION BY s) < doc_id AS late FROM w),
b AS (SELECT doc_id, i, c, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM l),
o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM b),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         string_agg(c, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM o GROUP BY doc_id)
SELECT h.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN a ON h.doc_id = a.doc_id
"""

SQL["op4_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d JOIN m ON d.doc_id = m.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS spot
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS i,
         lead(line) OVER (PARTITION BY doc_id ORDER BY spot) AS after
  FROM l WHERE regexp_matches(line, '[^ 	
]')),
p AS (
  SELECT doc_id, i, line, after, after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS late
  FROM s),
g AS (
  SELECT doc_id, i, late OR coalesce(lag(late) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM p),
o AS (
  SELECT doc_id, i, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
b AS (
  SELECT l.doc_id, l.spot, l.line, coalesce(o.gone, false) AS gone, coalesce(o.opens, false) AS opens
  FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.spot = s.spot LEFT JOIN o ON s.doc_id = o.doc_id AND s.i = o.i),
r AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed,
         (count(*) FILTER (WHERE opens))::BIGINT AS n_runs,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""

SQL["op10_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '[', ''), chr(31), '')) AS role_len,
         length(text) + length(text) - length(replace(replace(replace(replace(text, '\', ''), '<', ''), '[', ''), chr(31), '')) AS text_len
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_len + 1 + CASE WHEN before IS NOT DISTINCT FROM role AND k > 1 THEN 0 ELSE 9 + role_len END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""

SQL["op11_ranked_search"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, len(w)::BIGINT AS n FROM w WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (
  SELECT q.item_id, p.doc_id, sum(floor(1000 * ln((2 * g.N + 2)::DOUBLE / (2 * f.df + 1)::DOUBLE))::BIGINT
             * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * d.n * g.N) // g.L)))))::BIGINT AS score
  FROM q JOIN p ON q.term = p.term JOIN f ON f.term = p.term JOIN d ON d.doc_id = p.doc_id CROSS JOIN g GROUP BY q.item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
