"""Queries of this subpackage for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import embed, fingerprints, merkle, near, ordinal, packing, quality_rules, spm, substring, suffix, toxicity, urls, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.link(_table(spark, sf_dir, "embeddings"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.deduplicate(_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(_table(spark, sf_dir, "documents"))


def op13_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(_table(spark, sf_dir, "embeddings"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op11 by their digests, which SQL can express."""
    return op11_edit_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op2 and its base limits, which SQL can express."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = quality_rules.text_counts(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op5, without the model's verdict on the rest."""
    parts = _table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rule = urls.rule_of(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))


_OPERATORS = (
    op1_substring_dedup, op2_quality_rules, op3_toxicity, op4_suffix_array_dedup, op5_url_filter, op6_best_fit_packing, op7_sentencepiece, op8_embedding_near_dedup,
    op9_minhash_near_dedup, op10_quality_classifier, op11_edit_fingerprints, op12_merkle_manifest, op13_yinyang_clusters,
)
QUERIES = {f.__name__: f for f in (*_OPERATORS, quality_counts, url_rules, edited_texts)}


def _merkle_sql(tree_levels: int = 12, crest_levels: int = 6) -> str:
    """A manifest of up to 3**tree_levels rows a source and 3**crest_levels sources, level by level."""

    def climb(name: str, levels: int) -> list[str]:
        out = []
        for k in range(levels):
            out.append(f"""{name}_s{k} AS (SELECT *,
  CASE WHEN size > 1 THEN coalesce(string_agg(digest, '') OVER (PARTITION BY tree, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
  CASE WHEN size > 1 THEN coalesce(string_agg(digest, '') OVER (PARTITION BY tree, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b FROM {name}_{k})""")
            out.append(f"""{name}_{k + 1} AS (SELECT tree, idx // 3 AS idx, (size + 2) // 3 AS size,
  CASE WHEN size = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {name}_{k} GROUP BY tree, idx // 3, size)""")
        return out

    def follow(name: str, start: str, levels: int) -> list[str]:
        return [f"""{name}_p{k + 1} AS (SELECT p.* REPLACE (p.pos // 3 AS pos, p.proof || coalesce(s.a || s.b, '') AS proof,
  CASE WHEN s.size > 1 THEN sha256(s.a || p.fold || s.b) ELSE p.fold END AS fold)
  FROM {start if k == 0 else f"{name}_p{k}"} p JOIN {name}_s{k} s ON s.tree = p.{"tree" if name == "t" else "crest"} AND s.idx = p.pos)""" for k in range(levels)]

    said = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"
    head = " || ".join(said(x) for x in ("doc_id", "source", "lang", "n_chars"))
    even = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(0, 8)), lambda y, i: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END))) % 2 = 1"""
    parts = [f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {said("text")}) AS leaf,
  CASE WHEN {even} THEN sha256({head} || {said("replace(text, chr(10), '')")}) END AS other FROM documents)"""]
    parts.append("""n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM d)""")
    parts.append("t_0 AS (SELECT tree, idx, size, leaf AS digest FROM n)")
    parts += climb("t", tree_levels)
    parts.append(f"""c_0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS size, digest FROM t_{tree_levels})""")
    parts.append(f"""names AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM t_{tree_levels})""")
    parts += climb("c", crest_levels)
    parts.append("start AS (SELECT r, doc_id, leaf, tree, idx AS pos, '' AS proof, coalesce(other, leaf) AS fold FROM n)")
    parts += follow("t", "start", tree_levels)
    parts.append(f"""middle AS (SELECT r, doc_id, leaf, '' AS crest, place AS pos, proof, fold, subroot FROM t_p{tree_levels} JOIN names USING (tree))""")
    parts += follow("c", "middle", crest_levels)
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified
FROM c_p{crest_levels}, (SELECT digest FROM c_{crest_levels})"""


def _kmeans_sql() -> str:
    """Every vector against every centroid in each round."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: greatest(least(floor(256 * e::DOUBLE), {yinyang.MOST}), -{yinyang.MOST})::BIGINT) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {yinyang.COMPONENTS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)"""]
    parts.append(f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {yinyang.CLUSTERS})""")
    for k in range(yinyang.ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min(d) AS d, arg_min(c, (d, c)) AS c
  FROM (SELECT v.r, v.vec_id, c.c, {apart} AS d FROM v, c{k} c) GROUP BY r)""")
        if k < yinyang.ROUNDS:
            parts.append(f"""s{k} AS (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN v USING (r), range(1, {yinyang.COMPONENTS + 1}) t(i) GROUP BY c, i)""")
            parts.append(f"""m{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY c)""")
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN m{k} m ON m.c = o.c)""")
    last = yinyang.ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{last} a JOIN c{last} c ON c.c = a.c"""


_WORD = r"[^\x20\x09-\x0D]"
ORACLE_SQL: dict[str, str] = {
    "op12_merkle_manifest": _merkle_sql(),
    "op13_yinyang_clusters": _kmeans_sql(),
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER w AS first_ FROM documents WINDOW w AS (ORDER BY doc_id))
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(coalesce(after, first_), 1, length(text) // 2)) AS edited_sha256 FROM d""",
    "op4_suffix_array_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5(b[i + 1 : i + 400]) AS k FROM d, range(0, n - 399) t(i)),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS (SELECT r, i, sum(starts) OVER (PARTITION BY r ORDER BY i) AS s FROM (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 400)::INT AS starts FROM hit)),
spans AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM runs GROUP BY r, s),
parts AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(CASE WHEN a > before THEN hex(b[before + 1 : a]) ELSE '' END, '' ORDER BY a) || CASE WHEN max(z) < max(n) THEN hex(any_value(b)[max(z) + 1 : max(n)]) ELSE '' END AS x
  FROM parts JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, CASE WHEN x IS NULL THEN sha256(b) ELSE sha256(unhex(x)) END AS kept_sha256 FROM d LEFT JOIN cut USING (r)""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT x, y FROM p UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
least_ AS (SELECT x, min(y) AS y FROM reach GROUP BY x), links AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept FROM embeddings LEFT JOIN links ON links.x = vec_id LEFT JOIN least_ ON least_.x = vec_id""",
    "quality_counts": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
t AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w), g AS (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS three FROM t),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, range(0, 3) t(k) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, list_sum(list_prepend(0, list_transform(words, lambda x: length(x))))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
(len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n, 0) > 50 * len(words) AS base_failed FROM w LEFT JOIN covered USING (r)""",
    "url_rules": """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN best USING (page_id)""",
}
