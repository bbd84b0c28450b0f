"""One query per corpus operator over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm.common import table
from threadloom.llm.decontam import contamination
from threadloom.llm.licenses import NOTICES, PHRASES, scan_licenses
from threadloom.llm.merkle import manifest, proof_text
from threadloom.llm.packing import pack
from threadloom.llm.pii import KINDS, count_of, find_spans, listed
from threadloom.llm.quality import score_quality
from threadloom.llm.repeats import remove_repeats
from threadloom.llm.sentencepieces import encode_decode
from threadloom.llm.simhash import hex_fingerprint, near_duplicates
from threadloom.llm.topk import top_k
from threadloom.llm.toxicity import score_toxicity
from threadloom.llm.warc import archive_round_trip
from threadloom.llm.whitening import whiten


def op1_licenses(spark, sf_dir):
    """Which license phrases and notices does each text hold?"""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op2_pii(spark, sf_dir):
    """Which personal data does each text hold, by fixed kinds and by learnt contexts?"""
    found = find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        (F.size("spans") > 0).alias("has_personal_data"))


def op3_exact_top_k(spark, sf_dir):
    """Which five vectors have the highest integer inner product with each query vector?"""
    return top_k(table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark, sf_dir):
    """Which documents are linked by near-equal SimHash fingerprints?"""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op5_decontamination(spark, sf_dir):
    """Which documents hold benchmark passages, and of which items?"""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce(F.array_sort(F.col("items").cast("array<string>")), F.array().cast("array<string>"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op6_quality(spark, sf_dir):
    """How good is each document, and does it pass?"""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark, sf_dir):
    """How toxic is each document, and is it toxic?"""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark, sf_dir):
    """What do the archives of all pages hold, read back by byte ranges?"""
    found = archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_digests(found):
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_sentencepiece(spark, sf_dir, model_path=None):
    """Token ids of every text and the text they decode to, as digests."""
    return token_digests(encode_decode(table(spark, sf_dir, "documents"), model_path or piece_model()))


def op10_repeated_strings(spark, sf_dir):
    """Which bytes of each text belong to a long string that stands elsewhere as well?"""
    found = remove_repeats(table(spark, sf_dir, "documents"), passage_words=51)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", F.length("data").cast("long").alias("n_bytes"), removed.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        (F.size("spans") > 0).alias("has_repeats"), "shares_passage")


def op11_whitening(spark, sf_dir):
    """What are the leading whitened components of each vector?"""
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    """Which digests and proof does each document have, and does it still lead to the root once
    the line ends of some texts are gone?"""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n")))
    found = manifest(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", "verified")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark, sf_dir, tokenizer_path=None):
    """Which pieces of the documents make up each sequence of 4096 tokens?"""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path or word_tokenizer())


QUERIES = {q.__name__: q for q in (op1_licenses, op2_pii, op3_exact_top_k, op4_simhash_dedup, op5_decontamination, op6_quality,
                                  op7_toxicity, op8_warc, op9_sentencepiece, op10_repeated_strings,
                                  op11_whitening, op12_merkle_manifest, op13_packing)}

WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _templates_sql(templates) -> str:
    """(label, stride, need, ws) of each template."""
    rows = []
    for t in templates:
        own = sorted(set(t.words))
        rows.append(f"('{t.label}', {len(t.words)}, {t.need}, {_sql_list(t.words if t.phrase else own)})")
    return ", ".join(rows)


def _hex_value(digits: str) -> str:
    """Number of five hex digits."""
    return f"list_reduce(list_transform(string_split({digits}, ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, b: a * 16 + b)"


def _field_sql(value: str) -> str:
    """A leaf's part of a column."""
    return f"coalesce(concat(strlen(CAST({value} AS VARCHAR)), ':', {value}), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _crc32_sql(digits: str) -> str:
    """crc32 of ASCII text, a bit at a time."""
    byte = "list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))".format(digits)
    bits = "list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b))"
    return f"xor(list_reduce({byte}, lambda a, b: {bits}, 4294967295), 4294967295)"


def _levels_sql(name: str, nodes: str) -> str:
    """Table of all nodes (g, lvl, idx, h, n) over the lowest ones."""
    return f"""
{name}(g, lvl, idx, h, n) AS (
  SELECT g, 0, idx, h, count(*) OVER (PARTITION BY g) FROM {nodes}
  UNION ALL
  SELECT g, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, idx // 3, n)"""


def _climb_sql(name: str, start: str, levels: str) -> str:
    """Table of each row's way up (r, g, lvl, idx, h, done, p): its node's digest and its siblings so far."""
    return f"""
{name}(r, g, lvl, idx, h, done, p) AS (
  SELECT r, g, 0, idx, h, false, '' FROM {start}
  UNION ALL
  SELECT f.r, f.g, f.lvl + 1, f.idx // 3, sha256(string_agg(CASE WHEN s.idx = f.idx THEN f.h ELSE s.h END, '' ORDER BY s.idx)), false,
         f.p || coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx <> f.idx), '')
  FROM {name} f JOIN {levels} s ON s.g = f.g AND s.lvl = f.lvl AND s.idx // 3 = f.idx // 3
  WHERE s.n > 1 GROUP BY f.r, f.g, f.lvl, f.idx, f.h, f.p)"""


ORACLES = {
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS other
  FROM documents),
k AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx FROM d),
low AS (SELECT g, idx, leaf AS h FROM k),
{_levels_sql("node", "low")},
sub AS (SELECT 0 AS g, g - 1 AS idx, h, g AS of FROM node WHERE n = 1),
{_levels_sql("top", "sub")},
begin1 AS (SELECT r, g, idx, other AS h FROM k),
{_climb_sql("up1", "begin1", "node")},
end1 AS (SELECT r, g, h, p FROM up1 QUALIFY row_number() OVER (PARTITION BY r ORDER BY lvl DESC) = 1),
begin2 AS (SELECT r, 0 AS g, g - 1 AS idx, h FROM end1),
{_climb_sql("up2", "begin2", "top")},
end2 AS (SELECT r, h, p FROM up2 QUALIFY row_number() OVER (PARTITION BY r ORDER BY lvl DESC) = 1)
SELECT k.doc_id, k.leaf, sub.h AS subroot, t.h AS root, sha256(end1.p || end2.p) AS proof_sha256, end2.h AS folded_root, end2.h = t.h AS verified
FROM k JOIN sub ON sub.of = k.g JOIN end1 ON end1.r = k.r JOIN end2 ON end2.r = k.r CROSS JOIN (SELECT h FROM top WHERE n = 1) t
""",
    "op1_licenses": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
p(label, stride, need, ws) AS (VALUES {_templates_sql(PHRASES)}),
n(label, stride, need, ws) AS (VALUES {_templates_sql(NOTICES)}),
place AS (SELECT r, label, k - 1 AS pos, 1.0::DOUBLE AS s
          FROM (SELECT r, w, p.*, unnest(range(1, len(w) - len(ws) + 2)) AS k FROM d, p) WHERE w[k:k + len(ws) - 1] = ws),
block AS (SELECT r, label, need, len(ws) AS n, len(list_intersect(list_distinct(w[b * stride + 1:b * stride + 2 * stride]), ws)) AS o
          FROM (SELECT r, w, n.*, unnest(range(0, len(w) // stride + 1)) AS b FROM d, n)),
met AS (SELECT r, label, s FROM place UNION ALL SELECT r, label, o / n FROM block WHERE o >= need),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM place GROUP BY r),
every AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(s) AS score FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS keeper FROM h),
v AS (SELECT *, list_transform(range(0, 8), lambda j: {_hex_value("substr(hex, CAST(5 * j + 1 AS INTEGER), 5)")}) AS parts FROM k)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('{BASE32}', CAST(1 + ((parts[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM v
""",
    "op5_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
l AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM l)),
placed AS (SELECT r, p, k.n, array_to_string(w[p:p + k.n - 1], ' ') AS s
       FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) q, (SELECT DISTINCT n FROM win) k
       WHERE p + k.n - 1 <= len(w)),
hit AS (SELECT r, p, placed.n, item_id FROM placed JOIN win ON placed.n = win.n AND placed.s = win.s),
pos AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5
""",
}
