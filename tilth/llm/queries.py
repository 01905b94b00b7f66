"""The driver's queries on the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tilth.llm import byte_bpe, embedding_join, language_id, licenses, minhash, packing, personal_data, prefix_trie, quality, secret_scan, simhash, spelling, token_store
from tilth.llm.common import materialize

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORDS), capacity=2048, end_id=0)


def op2_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs)).select("doc_id", held_out(), "lang_pred", "score", "accepted")


def op3_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir)).drop("detections")


def op4_quality_classifier(spark, sf_dir):
    stats = materialize(quality.document_statistics(documents(spark, sf_dir)), "statistics")
    model = quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(stats, model).select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir), radius=2, width=3, seed=42)


def op6_minhash_fingerprints(spark, sf_dir):
    return minhash.edited_fingerprints(documents(spark, sf_dir))


def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTES), public_tokenizers.PATTERN)


def op8_token_store(spark, sf_dir):
    return token_store.store_documents(documents(spark, sf_dir), public_tokenizers.path(WORDS), end_id=2)


def op9_secret_scan(spark, sf_dir):
    found = secret_scan.scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op10_embedding_near_dedup(spark, sf_dir):
    return embedding_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op11_conversation_trie(spark, sf_dir):
    return prefix_trie.build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


def op13_personal_data(spark, sf_dir):
    found = personal_data.scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", of("email"), of("ip"), of("card"), of("phone"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


def queries():
    found = [
        op1_best_fit_packing, op2_language_id, op3_license_scan, op4_quality_classifier, op5_simhash_near_dedup, op6_minhash_fingerprints, op7_byte_bpe, op8_token_store,
        op9_secret_scan, op10_embedding_near_dedup, op11_conversation_trie, op12_spelling_variants, op13_personal_data,
    ]
    return {f.__name__: f for f in found}


SQL: dict[str, str] = {
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op11_conversation_trie": """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY i) AS own FROM t GROUP BY 1),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS host, (4294967295 - list_reduce(list_concat([4294967295::bigint],
    flatten(list_transform(range(1, 1 + length(conv_id::varchar)), lambda k: [ascii(substr(conv_id::varchar, k, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)) % 6 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(CASE WHEN g.own IS NULL THEN [] ELSE g.own[1:h.h] END, h.own[h.h + 1:]) AS p FROM h LEFT JOIN c g ON g.conv_id = h.host),
d AS (SELECT conv_id, p, unnest(range(0, 1 + len(p))) AS depth FROM r),
n AS (SELECT depth, p[1:depth] AS q, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (len(p) = depth), '')) AS ends_sha256 FROM d GROUP BY 1, 2),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(v.n, 0) AS n_children FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.q = n.q[1:n.depth - 1]
    LEFT JOIN (SELECT depth - 1 AS depth, q[1:depth - 1] AS q, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2) v ON v.depth = n.depth AND v.q = n.q),
a AS (SELECT depth, q, n_convs, n_children, unnest(range(0, depth + 1)) AS top FROM k)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256 FROM k
JOIN (SELECT top, q[1:top] AS q, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(q[depth].t) END)::bigint AS saved_tokens FROM a GROUP BY 1, 2) s
ON s.top = k.depth AND s.q = k.q""",
    "op12_spelling_variants": """WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, 4294967295 - list_reduce(list_concat([4294967295::bigint], flatten(list_transform(
    range(1, 1 + octet_length(encode(concat(doc_id, ':', run)))), lambda k: [('0x' || substr(hex(encode(concat(doc_id, ':', run))), 2 * k - 1, 2))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END) AS h FROM g),
m AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::bigint AS n FROM m WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
v AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM (SELECT word, n, unnest(range(1, 1 + length(word))) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.less = b.word),
k AS (SELECT a, count(*) AS n_near, max(n) AS most FROM p GROUP BY 1),
f AS (SELECT p.a, min(p.b) AS form, any_value(most) AS form_n FROM p JOIN k ON p.a = k.a AND p.n = k.most JOIN w ON w.word = p.a WHERE most >= 10 * w.n GROUP BY 1),
c AS (SELECT word, word AS root FROM w UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.a = c.root),
e AS (SELECT c.word, c.root FROM c LEFT JOIN f ON f.a = c.root WHERE f.a IS NULL)
SELECT w.word, f.form, e.root, w.n, coalesce(k.n_near, 0) AS n_near, f.form_n FROM w JOIN e ON e.word = w.word LEFT JOIN f ON f.a = w.word LEFT JOIN k ON k.a = w.word""",
}


def oracle_sql():
    return dict(SQL)
