"""The queries of the library over the driver's tables, with DuckDB SQL to hold them against.

``documents`` stand for source files (path: source/doc_id, language: lang),
``embeddings`` for vectors (label: cluster, vec_id: order of members),
``labels`` for analyses, ``pages.url`` for paths.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred import report
from kindred.functions import globs, text, vectors
from kindred.operators import analyze, clusters, embed, rerank, similarity, windows
from kindred.operators.components import connected_components
from kindred.plans import engine
from kindred.shared import shared_dir, table, written


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def chunk_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sliding_windows(files(spark, sf_dir), min_lines=5, max_lines=20)
    return out.select("file_path", "start_line", "end_line", text.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("chunk_id"))


LINES = "string_split(coalesce(text, ''), chr(10))"
CHUNK_SLIDING_WINDOW = f"""
WITH f AS (SELECT source || '/' || doc_id AS file_path, {LINES} AS ln FROM documents),
s AS (SELECT *, unnest(range(0, len(ln) - 5 + 1, 15)) AS i FROM f WHERE len(ln) >= 5),
e AS (SELECT *, least(i + 20, len(ln)) AS e0 FROM s),
b AS (SELECT *, CASE WHEN e0 < len(ln) THEN coalesce(list_max(list_filter(range(greatest(i + 5, e0 - 10) + 1, e0), lambda j: trim(ln[j + 1]) = '')), e0) ELSE e0 END AS e FROM e)
SELECT file_path, (i + 1)::INT AS start_line, e::INT AS end_line,
  file_path || ':' || (i + 1) || '-' || e || ':' || substr(sha256(array_to_string(ln[i + 1:e], chr(10))), 1, 12) AS chunk_id
FROM b WHERE e - i >= 5"""


def chunk_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = files(spark, sf_dir).withColumns({"start_line": F.lit(1), "end_line": F.size(text.lines(F.coalesce("content", F.lit("")))), "chunk_type": F.lit("block"), "name": F.col("language")})
    out = windows.split_oversized(whole, 10)
    return out.select("file_path", "start_line", "end_line", "chunk_type", "name", text.chunk_hash(F.col("content")).alias("chunk_hash"))


CHUNK_SPLIT_PARTS = f"""
WITH f AS (SELECT source || '/' || doc_id AS file_path, lang, text, {LINES} AS ln FROM documents),
p AS (SELECT *, unnest(range(0, CASE WHEN len(ln) > 10 THEN ceil(len(ln) / 10)::BIGINT ELSE 1 END)) AS k FROM f)
SELECT file_path, CASE WHEN len(ln) > 10 THEN k * 10 + 1 ELSE 1 END::INT AS start_line,
  CASE WHEN len(ln) > 10 THEN least((k + 1) * 10, len(ln)) ELSE len(ln) END::INT AS end_line,
  CASE WHEN len(ln) > 10 THEN 'block_part' ELSE 'block' END AS chunk_type,
  CASE WHEN len(ln) > 10 THEN lang || '_part' || (k + 1) ELSE lang END AS name,
  sha256(CASE WHEN len(ln) > 10 THEN array_to_string(ln[k * 10 + 1:(k + 1) * 10], chr(10)) ELSE text END) AS chunk_hash
FROM p"""


def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    n = F.size(text.lines(F.col("content")))
    path, content = F.col("file_path"), F.col("content")
    return f.select(
        text.chunk_id(path, F.lit(1), n, content).alias("chunk_id"),
        text.location(path, F.lit(1), n).alias("location"),
        text.line_count(F.lit(1), n).alias("line_count"),
        text.preview(content).alias("preview"),
        text.preview(content, 80).alias("preview_long"),
        text.chunk_hash(content).alias("chunk_hash"),
    )


def _preview(n: int) -> str:
    first = "trim(string_split(text, chr(10))[1])"
    return f"CASE WHEN length({first}) > {n} THEN substr({first}, 1, {n - 3}) || '...' ELSE {first} END"


CHUNK_IDENTITY = f"""
SELECT source || '/' || doc_id || ':1-' || len({LINES}) || ':' || substr(sha256(text), 1, 12) AS chunk_id,
  source || '/' || doc_id || ':1-' || len({LINES}) AS location, len({LINES})::INT AS line_count,
  {_preview(60)} AS preview, {_preview(80)} AS preview_long, sha256(text) AS chunk_hash
FROM documents"""


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.replace("text", F.lit(". "), F.lit("  \n\n\n")).alias("text"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gapped(spark, sf_dir).select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("normalized"))


NORMALIZED = r"""
g AS (SELECT doc_id, lang, string_split(replace(text, '. ', '  ' || chr(10) || chr(10) || chr(10)), chr(10)) AS ln FROM documents),
r AS (SELECT doc_id, lang, list_transform(ln, lambda x: regexp_replace(x, '\s+$', '')) AS ln FROM g),
j AS (SELECT doc_id, lang, array_to_string(list_filter(ln, lambda x, i: NOT (x = '' AND i > 1 AND ln[i - 1] = '')), chr(10)) AS t FROM r),
norm AS (SELECT doc_id, lang, CASE WHEN length(t) > 2048 THEN substr(t, 1, 2048) || chr(10) || '# ... (truncated)' ELSE t END AS t FROM j)"""
NORMALIZE_TEXT = f"WITH {NORMALIZED} SELECT doc_id, sha256(t) AS normalized FROM norm"


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "").otherwise(F.concat(F.lit("f"), "doc_id"))
    return _gapped(spark, sf_dir).select("doc_id", F.sha2(text.embedding_text(F.col("lang"), F.lit("block"), name, F.col("text")), 256).alias("embedded"))


EMBEDDING_TEXT = f"""WITH {NORMALIZED}
SELECT doc_id, sha256('# ' || lang || ' block' || CASE WHEN doc_id % 3 = 2 THEN ': f' || doc_id ELSE '' END || chr(10) || t) AS embedded FROM norm"""


def path_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.filter(globs.selected(F.col("path"), exclude=["*[02468]"], focus=["*/*[a-m]*/*", "*.html"], defaults=True)).select("page_id", globs.base_name(F.col("path")).alias("base_name"))


def _sql_globs(patterns: list[str]) -> str:
    return " OR ".join(f"regexp_full_match(path, '{globs.glob_to_regex(g)[5:-2]}', 's')" for g in patterns)


PATH_GLOB_FILTER = f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages)
SELECT page_id, string_split(path, '/')[-1] AS base_name FROM p
WHERE NOT ({_sql_globs(globs.DEFAULT_EXCLUDES + ["*[02468]"])})
  AND ({_sql_globs(["*/*[a-m]*/*", "*.html"])} OR regexp_full_match(string_split(path, '/')[-1], '.*\\.html', 's'))"""


def _cache_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), text.chunk_hash(F.col("text")).alias("chunk_hash"), "doc_id")
    return chunks, chunks.filter("doc_id % 2 = 0").select("file_path", "chunk_hash", F.lit("m").alias("model_id"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, cache = _cache_sides(spark, sf_dir)
    return embed.hits(chunks, cache, "m").select("doc_id")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, cache = _cache_sides(spark, sf_dir)
    return embed.misses(chunks, cache, "m").select("doc_id")


def l2_normalize_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm and a weighted sum of the elements of normalised vectors; vec_id scales them, 0 makes a zero vector."""
    scaled = F.transform("embedding", lambda x, i: x.cast("double") * F.col("vec_id") + i * F.signum("vec_id"))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(scaled).alias("u"))
    weighted = F.aggregate(F.transform("u", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(vectors.norm(F.col("u")), 6).alias("norm"), F.round(weighted, 4).alias("weighted"))


L2_NORMALIZE = """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE * vec_id + (i - 1) * sign(vec_id)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM s)
SELECT vec_id, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm,
  round(CASE WHEN n > 0 THEN list_sum(list_transform(v, lambda x, i: x * i)) / n ELSE 0.0 END, 4) AS weighted FROM n"""


def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35, "vec_id")
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"))


PAIRS = """
SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"""


def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similarity.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35, "vec_id")
    return connected_components(pairs, shared_dir(spark)).select(F.col("node").alias("vec_id"), "component")


SIMILARITY_COMPONENTS = f"""
WITH RECURSIVE p AS (SELECT a, b FROM ({PAIRS}) WHERE s > 0.35), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
walk AS (SELECT a AS vec_id, a AS other FROM e UNION SELECT w.vec_id, e.b FROM walk w JOIN e ON w.other = e.a)
SELECT vec_id, min(other) AS component FROM walk GROUP BY vec_id"""


def agglomerative_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cluster_vectors(table(spark, sf_dir, "embeddings"), shared_dir(spark), 0.35, key="vec_id").select("cluster", F.col("key").alias("vec_id"))


#: Average linkage in every component at once: each step merges the most similar pair of each, until none is above the threshold.
AGGLOMERATIVE_CLUSTERS = f"""
WITH RECURSIVE {SIMILARITY_COMPONENTS.strip().removeprefix("WITH RECURSIVE").replace("\nSELECT vec_id, min(other) AS component FROM walk GROUP BY vec_id", ",\npart AS (SELECT vec_id, min(other) AS component FROM walk GROUP BY vec_id)")},
step AS (
  SELECT 0 AS k, p.component AS c, x.a, x.b, x.s, 1::BIGINT AS na, 1::BIGINT AS nb, false AS over
  FROM ({PAIRS}) x JOIN part p ON p.vec_id = x.a JOIN part q ON q.vec_id = x.b AND q.component = p.component
  UNION ALL
  SELECT k + 1, c, least(i, j), greatest(i, j), sum(s * w) / sum(w), max(CASE WHEN i < j THEN ni ELSE nj END), max(CASE WHEN i < j THEN nj ELSE ni END), false
  FROM (
    SELECT k, c, s, CASE WHEN a = hi THEN lo ELSE a END AS i, CASE WHEN b = hi THEN lo ELSE b END AS j,
      CASE WHEN a IN (lo, hi) THEN nlo + nhi ELSE na END AS ni, CASE WHEN b IN (lo, hi) THEN nlo + nhi ELSE nb END AS nj,
      CASE WHEN a IN (lo, hi) THEN na WHEN b IN (lo, hi) THEN nb ELSE 1 END AS w, a = lo AND b = hi AS merged
    FROM (
      SELECT *, first_value(a) OVER best AS lo, first_value(b) OVER best AS hi, first_value(na) OVER best AS nlo, first_value(nb) OVER best AS nhi, first_value(s) OVER best AS top
      FROM step WINDOW best AS (PARTITION BY c ORDER BY s DESC, a, b))
    WHERE top > 0.35)
  WHERE NOT merged GROUP BY k, c, least(i, j), greatest(i, j)),
merges AS (
  SELECT k, c, a AS lo, b AS hi FROM (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY s DESC, a, b) AS r FROM step) WHERE r = 1 AND s > 0.35),
label AS (
  SELECT -1 AS k, component AS c, vec_id, vec_id AS cluster FROM part
  UNION ALL
  SELECT l.k + 1, l.c, l.vec_id, CASE WHEN l.cluster = m.hi THEN m.lo ELSE l.cluster END FROM label l JOIN merges m ON m.c = l.c AND m.k = l.k + 1),
final AS (SELECT vec_id, arg_max(cluster, k) AS cluster FROM label GROUP BY vec_id)
SELECT cluster, vec_id FROM final WHERE cluster IN (SELECT cluster FROM final GROUP BY cluster HAVING count(*) >= 2)"""


def cluster_vectors_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering with all its facts: members, sizes, files, lines, similarity, medoid and number of each cluster."""
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("f"), "label").alias("file_path"), F.lit(1).cast("long").alias("start_line"), (1 + F.col("vec_id") % 7).alias("end_line"), "embedding")
    found, _ = engine.cluster_chunks(chunks, 0.35)
    return found.select("cluster_id", F.round("similarity", 4).alias("similarity"), "size", "file_count", "total_lines", "representative", "first_member")


CLUSTER_VECTORS_WHOLE = f"""{AGGLOMERATIVE_CLUSTERS.replace("SELECT cluster, vec_id FROM final WHERE", ", found AS (SELECT cluster, vec_id FROM final WHERE")}),
mem AS (SELECT cluster, vec_id, embedding::DOUBLE[] AS e, label, 1 + vec_id % 7 AS n, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) - 1 AS idx FROM found JOIN embeddings USING (vec_id)),
sim AS (SELECT x.cluster, avg(list_cosine_similarity(x.e, y.e)) AS similarity FROM mem x JOIN mem y ON x.cluster = y.cluster AND x.vec_id < y.vec_id GROUP BY x.cluster),
flat AS (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM mem),
mean AS (SELECT cluster, list(x ORDER BY d) AS v FROM (SELECT cluster, d, avg(x) AS x FROM flat GROUP BY cluster, d) GROUP BY cluster),
near AS (SELECT cluster, idx, row_number() OVER (PARTITION BY cluster ORDER BY round(list_cosine_similarity(e, v), 12) DESC, idx) AS r FROM mem JOIN mean USING (cluster)),
facts AS (SELECT cluster, count(*) AS size, count(DISTINCT label) AS file_count, sum(n)::BIGINT AS total_lines FROM mem GROUP BY cluster)
SELECT row_number() OVER (ORDER BY similarity DESC, cluster) AS cluster_id, round(similarity, 4) AS similarity, size, file_count, total_lines, idx AS representative, cluster AS first_member
FROM facts JOIN sim USING (cluster) JOIN near USING (cluster) WHERE r = 1"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("member_idx"), "embedding")


def cluster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.mean_similarity(_labelled(spark, sf_dir))
    return out.select("cluster_id", "n", F.round("similarity", 6).alias("similarity"))


CLUSTER_SIMILARITY = """
WITH p AS (SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT n.label::BIGINT AS cluster_id, n, round(coalesce(s, 1.0), 6) AS similarity FROM n LEFT JOIN p USING (label)"""


def cluster_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.medoids(_labelled(spark, sf_dir))
    return out.select("cluster_id", "member_idx", F.round("similarity", 6).alias("similarity"))


MEDOIDS = """
x AS (SELECT label, vec_id, embedding, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
m AS (SELECT label, list(m ORDER BY d) AS mean FROM (SELECT label, d, avg(x) AS m FROM x GROUP BY label, d) GROUP BY label),
s AS (SELECT label, vec_id, embedding, list_cosine_similarity(embedding::DOUBLE[], mean) AS s FROM embeddings JOIN m USING (label)),
medoid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 12) DESC, vec_id) AS r FROM s) WHERE r = 1)"""
CLUSTER_MEDOID = f"WITH {MEDOIDS} SELECT label::BIGINT AS cluster_id, vec_id AS member_idx, round(s, 6) AS similarity FROM medoid"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text as clusters of one-chunk files."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.sha2("text", 256).alias("cluster"), "doc_id", F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.size(text.lines(F.col("text"))).alias("end_line"), "text", "lang")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    stats = clusters.cluster_stats(members, "cluster")
    first = members.groupBy("cluster").agg(F.min("doc_id").alias("first_member"))
    rated = stats.join(first, "cluster").withColumn("similarity", (F.lit(1.0) - (F.col("first_member") % 7) / 10.0))
    return clusters.renumber(rated)


NUMBERED = f"""
m AS (SELECT sha256(text) AS cluster, doc_id, source AS file_path, len({LINES}) AS n, text, lang FROM documents),
c AS (SELECT cluster, count(*) AS size, count(DISTINCT file_path) AS file_count, sum(n)::BIGINT AS total_lines, min(doc_id) AS first_member FROM m GROUP BY cluster HAVING count(*) >= 2),
k AS (SELECT *, 1.0::DOUBLE - (first_member % 7) / 10.0::DOUBLE AS similarity FROM c),
numbered AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, first_member) AS cluster_id FROM k)"""


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_stats(_members(spark, sf_dir), "cluster")


def cluster_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("cluster_id", "first_member", "size", F.round("similarity", 6).alias("similarity"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _labelled(spark, sf_dir)
    best = clusters.medoids(members).select("cluster_id", F.col("member_idx").alias("rep")).join(members.select("cluster_id", F.col("member_idx").alias("rep"), F.col("embedding").alias("v")), ["cluster_id", "rep"])
    return members.join(best, "cluster_id").select("cluster_id", "member_idx", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


SCORED = f"{MEDOIDS}, scored AS (SELECT e.label::BIGINT AS cluster_id, e.vec_id AS member_idx, round(list_cosine_similarity(e.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS score FROM embeddings e JOIN medoid m USING (label))"
KEPT = f"""{SCORED},
w AS (SELECT *, count(*) FILTER (score >= 0.3) OVER (PARTITION BY cluster_id) AS ok, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, member_idx) AS rk,
  count(*) FILTER (score >= 0.3) OVER (PARTITION BY cluster_id ORDER BY member_idx) AS bf FROM scored),
kept AS (SELECT cluster_id, member_idx, score, CASE WHEN ok >= 2 THEN bf - 1 ELSE rk - 1 END AS kept_idx FROM w WHERE CASE WHEN ok >= 2 THEN score >= 0.3 ELSE rk <= 2 END)"""


def rerank_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.rerank_keep(_scored(spark, sf_dir), 0.3)


def rerank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    out = clusters.rerank_summary(clusters.rerank_stats(scored, clusters.rerank_keep(scored, 0.3)))
    return out.withColumn("mean_filter_rate", F.round("mean_filter_rate", 6))


RERANK_SUMMARY = f"""WITH {KEPT},
a AS (SELECT cluster_id, count(*) AS o FROM scored GROUP BY cluster_id), b AS (SELECT cluster_id, count(*) AS f FROM kept GROUP BY cluster_id)
SELECT count(*) AS clusters, sum(o)::BIGINT AS original, sum(f)::BIGINT AS filtered, sum(o - f)::BIGINT AS removed, round(avg((1 - f / o) * 100), 6) AS mean_filter_rate FROM a JOIN b USING (cluster_id)"""


def rerank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set similarity of each benchmark item to the next one."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return rerank.score_pairs(pairs, "text", "other").select("item_id", F.round("score", 6).alias("score"))


RERANK_PAIRS = r"""
WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_\x{80}-\x{10FFFF}]+'), lambda x: x <> '')) AS t FROM benchmark)
SELECT a.item_id, round(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(a.t || b.t)), 0)::DOUBLE, 6) AS score FROM w a JOIN w b ON b.item_id = a.item_id + 1"""


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return labels.select(F.col("doc_id").alias("first_member"), (F.col("quality") == 1).alias("worth_refactoring"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("complexity"))


def _ranked(sort_by: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        numbered = _numbered(spark, sf_dir)
        found = numbered.select("cluster_id", "first_member").join(_analyses(spark, sf_dir), "first_member")
        out = clusters.rank(numbered, found, sort_by)
        return out.select("cluster_id", "position", F.round("rank_score", 6).alias("rank_score"))

    query.__name__ = f"rank_{sort_by.replace('-', '_')}"
    return query


SCORES = {
    "severity": "CASE WHEN NOT coalesce(worth, true) THEN 0.01::DOUBLE ELSE (total_lines * file_count + (1 - similarity) * file_count * 10) * CASE complexity WHEN 'low' THEN 1.0::DOUBLE WHEN 'high' THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END END",
    "lines": "total_lines::DOUBLE",
    "files": "file_count::DOUBLE",
    "similarity": "similarity",
    "quick-wins": "CASE WHEN NOT coalesce(worth, true) THEN 0.01::DOUBLE ELSE similarity * CASE complexity WHEN 'low' THEN 3.0::DOUBLE WHEN 'medium' THEN 1.5::DOUBLE WHEN 'high' THEN 0.5::DOUBLE WHEN 'n/a' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * least(total_lines, 100) END",
}


def _rank_sql(sort_by: str) -> str:
    return f"""WITH {NUMBERED},
l AS (SELECT doc_id AS first_member, max(quality) = 1 AS worth, CASE WHEN max(toxic) = 1 THEN 'high' ELSE 'low' END AS complexity FROM labels GROUP BY doc_id),
r AS (SELECT cluster_id, {SCORES[sort_by]} AS s FROM numbered LEFT JOIN l USING (first_member))
SELECT cluster_id, row_number() OVER (ORDER BY s DESC, cluster_id) AS position, round(s, 6) AS rank_score FROM r"""


def pending_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _numbered(spark, sf_dir)
    done = numbered.select("cluster_id", "first_member").join(_analyses(spark, sf_dir), "first_member")
    return analyze.pending(numbered, done).select("cluster_id", "first_member")


def topk_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return clusters.top_regions(docs.select("source", "doc_id"), 3, "source", "doc_id")


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    numbered = _numbered(spark, sf_dir).withColumn("position", F.col("cluster_id"))
    members = _members(spark, sf_dir).join(numbered.select("cluster", "cluster_id"), "cluster")
    return numbered, members.select("cluster_id", F.col("doc_id").alias("member_idx"), "file_path", "start_line", "end_line", F.lit("block").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.col("text").alias("content"), F.col("lang").alias("language"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.report_frame(*_reported(spark, sf_dir)).select("id", "similarity", F.explode("regions").alias("r"))
    return rows.select(F.col("id").alias("cluster_id"), "similarity", F.col("r.member_idx").alias("doc_id"), "r.file", "r.start_line", "r.end_line", "r.preview")


REPORT_ROWS = f"""WITH {NUMBERED} SELECT cluster_id, round(similarity, 4) AS similarity, doc_id, file_path AS file, 1 AS start_line, n::INT AS end_line, {_preview(80)} AS preview FROM m JOIN numbered USING (cluster)"""


def report_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the JSON report."""
    meta = json.loads(report.json_report(report.collect(*_reported(spark, sf_dir)), sf_dir, 0.8))["meta"]
    return spark.createDataFrame([(meta["cluster_count"], meta["total_duplicated_lines"])], "cluster_count long, total_duplicated_lines long")


def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _numbered(spark, sf_dir)
    members = _members(spark, sf_dir).join(numbered.select("cluster", "cluster_id"), "cluster")
    return members.withColumn("member_idx", F.row_number().over(Window.partitionBy("cluster_id").orderBy("doc_id")) - 1).select("cluster_id", "member_idx", "file_path", "start_line", "end_line", F.col("lang").alias("language"), F.col("text").alias("content"))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.prompts(_prompted(spark, sf_dir)).select("cluster_id", F.sha2("prompt", 256).alias("prompt"))


PROMPT_BUILD = f"""WITH {NUMBERED},
o AS (SELECT cluster_id, size, file_path, n, lang, text, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS r FROM m JOIN numbered USING (cluster)),
g AS (SELECT cluster_id, max(size) AS size, string_agg('Region ' || r || ': ' || file_path || ' (lines 1-' || n || ')' || chr(10) || '```' || lang || chr(10) ||
  CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || chr(10) || '// ... (truncated)' ELSE text END || chr(10) || '```' || chr(10), chr(10) ORDER BY r) FILTER (r <= 3) AS regions FROM o GROUP BY cluster_id)
SELECT cluster_id, sha256('<|im_start|>system' || chr(10) || '{analyze.SYSTEM.replace("'", "''")}' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) ||
  size || ' code regions look alike.' || chr(10) || chr(10) || regions || CASE WHEN size > 3 THEN chr(10) || '(Plus ' || (size - 3) || ' more similar regions)' || chr(10) ELSE '' END || chr(10) ||
  '{analyze.ASK}' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '{{"') AS prompt FROM g"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("quality"), F.col("doc_id")
    body = F.concat(
        F.lit('commonality": "  Both regions read rows and add them up, case '), d, F.lit('", "worth_refactoring": '), F.when(q == 1, "true").when(d % 2 == 0, '"no"').otherwise("false"),
        F.lit(', "abstraction": "'), F.when(d % 5 == 0, "short").otherwise("Move the shared loop into one helper function."), F.lit('", "suggested_name": "'), F.when(d % 3 == 0, "N/A").otherwise("sumRows"),
        F.lit('", "complexity": "'), F.when(d % 4 == 0, "LOW").when(d % 4 == 1, "huge").when(d % 4 == 2, "none").otherwise("high"), F.lit('"}'),
    )
    shaped = F.when(d % 3 == 1, F.concat(F.lit("```json\n{\""), body, F.lit("\n```"))).when(d % 7 == 2, F.concat(F.lit("<think>{no}</think>{\""), body)).otherwise(body)
    return table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", shaped.alias("output"))


def parse_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.parse(_answers(spark, sf_dir), "output").filter("analysis.commonality is not null").select("doc_id", "analysis.commonality", "analysis.abstraction", "analysis.suggested_name", "analysis.complexity", "analysis.worth_refactoring")


PARSE_ANALYSIS = """
WITH a AS (SELECT doc_id, quality = 1 AS worth FROM labels WHERE doc_id % 5 <> 0)
SELECT doc_id, 'Both regions read rows and add them up, case ' || doc_id AS commonality,
  'Move the shared loop into one helper function.' AS abstraction,
  CASE WHEN doc_id % 3 <> 0 THEN 'sumRows' WHEN worth THEN 'sharedUtility' ELSE 'n/a' END AS suggested_name,
  CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN CASE WHEN worth THEN 'medium' ELSE 'n/a' END ELSE 'high' END AS complexity,
  worth AS worth_refactoring FROM a"""


def _cache(spark: SparkSession, sf_dir: str) -> embed.VectorCache:
    """A new cache with a row for each vector, its label as the model."""
    cache = embed.VectorCache(spark, f"{shared_dir(spark)}/query-cache-{uuid.uuid4().hex}")
    cache.upsert(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("file_path"), F.lit("h").alias("chunk_hash"), "embedding", F.concat(F.lit("m"), "label").alias("model_id")))
    return cache


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cache(spark, sf_dir).stats()
    return spark.createDataFrame([(found["entries"], ",".join(found["models"]))], "entries long, models string")


def cache_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache holds after an upsert of rows that it has, a deleted model, a deleted file, and a vacuum."""
    cache = _cache(spark, sf_dir)
    rows = cache.read()
    cache.upsert(rows.filter("cast(file_path AS int) % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    cache.delete_model("m1")
    cache.delete_file("7")
    cache.vacuum()
    scale = F.sqrt(F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return cache.read().select(F.col("file_path").cast("long").alias("vec_id"), "model_id", F.round(scale, 3).alias("norm"))


CACHE_EDITS = """
SELECT vec_id, 'm' || label AS model_id, round(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS norm
FROM embeddings WHERE label <> 1 AND vec_id <> 7"""


def embed_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's vector where even ids come from the cache, which holds vectors of another text for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.col("text").alias("embed_text"))
    cache, model = embed.VectorCache(spark, f"{shared_dir(spark)}/query-cache-{uuid.uuid4().hex}"), embed.HashingEmbedder()
    given = F.array(*[F.lit(2.0 if k == 0 else 0.0).cast("float") for k in range(model.dim)])
    cache.upsert(docs.filter("doc_id % 2 = 0").select("file_path", F.sha2("embed_text", 256).alias("chunk_hash"), given.alias("embedding"), F.lit(model.model_id).alias("model_id")))
    norm = F.sqrt(F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return embed.embed_cached(docs, cache, "embed_text", model).select("doc_id", F.size("embedding").alias("dims"), F.round(norm, 3).alias("norm"))


EMBED_WITH_CACHE = "SELECT doc_id, 256 AS dims, CASE WHEN doc_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM documents"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of similar documents: embedding, similarity join, average linkage, facts, order."""
    docs = table(spark, sf_dir, "documents")
    embedded = embed.embed(docs.select(F.col("doc_id").alias("key"), F.col("source").alias("file_path"), F.lit(1).alias("start_line"), F.size(text.lines(F.col("text"))).alias("end_line"), text.embedding_text(F.col("lang"), F.lit("block"), F.lit(None).cast("string"), F.col("text")).alias("embed_text")), "embed_text")
    vecs = written(embedded.drop("embed_text"), "flagship-vectors")
    found, _ = engine.cluster_chunks(vecs, 0.80)
    return found.select("cluster_id", F.round("similarity", 4).alias("similarity"), "size", "file_count", "total_lines", "representative", "first_member")


RANKS = [_ranked(s) for s in clusters.SORTS]
ALL = [
    chunk_sliding_window, chunk_split_parts, chunk_identity, normalize_text, embedding_text, path_glob_filter, cache_hits, cache_misses, l2_normalize_check, pair_cosine,
    similarity_components, agglomerative_clusters, cluster_vectors_whole, cluster_similarity, cluster_medoid, cluster_stats, cluster_renumber, rerank_keep, rerank_summary, rerank_pairs,
    *RANKS, pending_analyses, topk_regions, report_rows, report_meta, prompt_build, parse_analysis, cache_stats, cache_edits, embed_with_cache, flagship,
]


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL; ``flagship``, whose vectors SQL can't make, has none."""
    return {
        "chunk_sliding_window": CHUNK_SLIDING_WINDOW,
        "chunk_split_parts": CHUNK_SPLIT_PARTS,
        "chunk_identity": CHUNK_IDENTITY,
        "normalize_text": NORMALIZE_TEXT,
        "embedding_text": EMBEDDING_TEXT,
        "path_glob_filter": PATH_GLOB_FILTER,
        "cache_hits": "SELECT doc_id FROM documents WHERE doc_id % 2 = 0",
        "cache_misses": "SELECT doc_id FROM documents WHERE doc_id % 2 <> 0",
        "l2_normalize_check": L2_NORMALIZE,
        "pair_cosine": f"SELECT a, b, round(s, 6) AS similarity FROM ({PAIRS}) WHERE s > 0.35",
        "similarity_components": SIMILARITY_COMPONENTS,
        "agglomerative_clusters": AGGLOMERATIVE_CLUSTERS,
        "cluster_vectors_whole": CLUSTER_VECTORS_WHOLE,
        "cluster_similarity": CLUSTER_SIMILARITY,
        "cluster_medoid": CLUSTER_MEDOID,
        "cluster_stats": f"WITH {NUMBERED} SELECT cluster, size, file_count, total_lines FROM c",
        "cluster_renumber": f"WITH {NUMBERED} SELECT cluster_id, first_member, size, round(similarity, 6) AS similarity FROM numbered",
        "rerank_keep": f"WITH {KEPT} SELECT cluster_id, member_idx, score, kept_idx FROM kept",
        "rerank_summary": RERANK_SUMMARY,
        "rerank_pairs": RERANK_PAIRS,
        **{f"rank_{s.replace('-', '_')}": _rank_sql(s) for s in clusters.SORTS},
        "pending_analyses": f"WITH {NUMBERED} SELECT cluster_id, first_member FROM numbered WHERE first_member NOT IN (SELECT doc_id FROM labels)",
        "topk_regions": "SELECT source, doc_id, region FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS region FROM documents) WHERE region <= 3",
        "report_rows": REPORT_ROWS,
        "report_meta": f"WITH {NUMBERED} SELECT count(*) AS cluster_count, coalesce(sum(total_lines), 0)::BIGINT AS total_duplicated_lines FROM numbered",
        "prompt_build": PROMPT_BUILD,
        "parse_analysis": PARSE_ANALYSIS,
        "cache_stats": "SELECT count(*) AS entries, string_agg(DISTINCT 'm' || label, ',' ORDER BY 'm' || label) AS models FROM embeddings",
        "cache_edits": CACHE_EDITS,
        "embed_with_cache": EMBED_WITH_CACHE,
    }
