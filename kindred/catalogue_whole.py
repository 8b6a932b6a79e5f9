"""More queries with SQL: chunkers of each language, scanning, reranking and analysis as a whole, and facts beside them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import catalogue as base
from kindred import report
from kindred.examples import BODIES, CASES
from kindred.functions import text, vectors
from kindred.operators import analyze, clusters, rerank
from kindred.shared import filesystem, shared_dir, table
from kindred.sources.chunkers import chunk_files
from kindred.sources.files import scan
from kindred.sources.languages import language_of


def _values(rows: list[tuple], columns: str) -> str:
    plain = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(plain, r)) + ")" for r in rows) + f") v({columns})"


def _examples(language: str) -> list[tuple]:
    return [c[language] for c in (CASES, BODIES) if language in c]


def _chunks_of(language: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = spark.createDataFrame([(f"{language}/{k}", language, source) for k, (source, _) in enumerate(_examples(language))], "file_path string, language string, content string")
        return chunk_files(files, 2, 100).select("file_path", "start_line", "end_line", "chunk_type", "name", "context")

    query.__name__ = f"chunk_{language}"
    return query


def _chunks_sql(language: str) -> str:
    return _values([(f"{language}/{k}", *r) for k, (_, found) in enumerate(_examples(language)) for r in found], "file_path, start_line, end_line, chunk_type, name, context")


def chunk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 chunks by path and lines, by the registry's chunkers (windows for what has no chunker)."""
    out = chunk_files(base.files(spark, sf_dir), 5, 20, 300)
    return out.select("file_path", "start_line", "end_line", text.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("chunk_id"))


CHUNK_MAX = f"SELECT * FROM ({base.CHUNK_SLIDING_WINDOW}) ORDER BY file_path, start_line, end_line LIMIT 300"

#: Files of a small tree: path, bytes, and language and text where the file is scanned.
TREE = [
    ("a.py", b"x\r\ny\rz", "python", "x\ny\nz"),
    ("lib/b.test.TSX", b"let b\n", "typescript", "let b\n"),
    (".dot.py", "ü中\U0001f600".encode() + b"\xffok", "python", "ü中\U0001f600�ok"),
    ("src/d.RS", b"", "rust", ""),
    ("src/deep/er/e.h", b"int e;\r\n", "c", "int e;\n"),
    ("b.txt", b"no", None, None),
    ("noext", b"no", None, None),
    ("node_modules/c.js", b"no", None, None),
]


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files read back as source files."""
    root = f"{shared_dir(spark)}/query-tree-{uuid.uuid4().hex}"
    files, path = filesystem(root)
    for name, body, *_ in TREE:
        files.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(body)
    return scan(spark, root).select("file_path", "language", "content", F.col("size").cast("int").alias("size"))


def _scan_sql() -> str:
    # Text goes in as bytes, since it has line ends.
    rows = [(p, language, content.encode().hex(), len(body)) for p, body, language, content in TREE if language]
    return f"SELECT file_path, language, decode(unhex(content)) AS content, size FROM ({_values(rows, 'file_path, language, content, size')})"


ENDINGS = [(".py", "python"), (".PYW", "python"), (".tsx", "typescript"), (".mjs", "javascript"), (".h", "c"), (".hxx", "cpp"), (".kts", "kotlin"), (".sc", "scala"), (".zsh", "bash"), (".cs", "csharp"), (".md", None), ("", None), (".py/x", None)]


def path_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a path for each document, whose extension goes by its id."""
    ends = F.array(*[F.lit(e) for e, _ in ENDINGS])
    path = F.concat(F.lit("d.x/"), "doc_id", F.element_at(ends, (F.col("doc_id") % len(ENDINGS) + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", language_of(path).alias("language"))


PATH_LANGUAGE = f"SELECT doc_id, ([{', '.join('NULL' if x is None else repr(x) for _, x in ENDINGS)}])[(doc_id % {len(ENDINGS)} + 1)::INT] AS language FROM documents"


def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector to the next one."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(vectors.distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


VECTOR_DISTANCE = "SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def yes_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yes / (yes + no) from log probabilities that go by the id, some of them missing."""
    d = F.col("doc_id")
    yes, no = F.when(d % 11 != 0, -(d % 7) / 2), F.when(d % 13 != 0, -(d % 5) / 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(vectors.yes_probability(yes, no), 6).alias("p"))


YES_PROBABILITY = """
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN exp(-(doc_id % 7) / 2.0) ELSE 0 END AS y, CASE WHEN doc_id % 13 <> 0 THEN exp(-(doc_id % 5) / 3.0) ELSE 0 END AS n FROM documents)
SELECT doc_id, round(CASE WHEN y + n > 0 THEN y / (y + n) ELSE 0.5 END, 6)::DOUBLE AS p FROM e"""

ANSWERS = [("Yes.", 0.75), ("no", 0.25), ("irrelevant", 0.25), ("It may be", 0.5), ("relevant, but not quite", 0.25), ("TRUE", 0.75), ("", 0.5)]


def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of generated answers, which go by the document's id."""

    @F.pandas_udf("double")
    def score(answers: pd.Series) -> pd.Series:
        return answers.map(rerank.parse_score).astype("float64")

    answers = F.array(*[F.lit(a) for a, _ in ANSWERS])
    return table(spark, sf_dir, "documents").select("doc_id", score(F.element_at(answers, (F.col("doc_id") % len(ANSWERS) + 1).cast("int"))).alias("score"))


SCORE_ANSWERS = f"SELECT doc_id, ([{', '.join(str(s) for _, s in ANSWERS)}]::DOUBLE[])[(doc_id % {len(ANSWERS)} + 1)::INT] AS score FROM documents"


def rerank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = base._scored(spark, sf_dir)
    out = clusters.rerank_stats(scored, clusters.rerank_keep(scored, 0.3))
    return out.withColumn("filter_rate", F.round("filter_rate", 6))


RERANK_STATS = f"""WITH {base.KEPT},
a AS (SELECT cluster_id, count(*) AS original_size, min(score) AS min_score, max(score) AS max_score FROM scored GROUP BY cluster_id), b AS (SELECT cluster_id, count(*) AS filtered_size FROM kept GROUP BY cluster_id)
SELECT cluster_id, original_size, min_score, max_score, filtered_size, round((1 - filtered_size / original_size) * 100, 6) AS filter_rate FROM a JOIN b USING (cluster_id)"""


def rerank_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, four to a cluster whose second one represents it, reranked: what stays, numbered anew."""
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("cluster_id"), (F.col("item_id") % 4).alias("member_idx"), "item_id", F.col("text").alias("content"))
    members, _ = rerank.rerank(items, items.select("cluster_id").distinct().withColumn("member_idx", F.lit(1).cast("long")), 0.15, 2)
    return members.select("cluster_id", "member_idx", "item_id", F.round("score", 6).alias("score"))


RERANK_WHOLE = r"""
WITH i AS (SELECT item_id // 4 AS cluster_id, item_id % 4 AS m, item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_\x{80}-\x{10FFFF}]+'), lambda x: x <> '')) AS t FROM benchmark),
s AS (SELECT a.cluster_id, a.m, a.item_id, CASE WHEN a.m = 1 THEN 1.0 ELSE coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(a.t || b.t)), 0)::DOUBLE, 0.5) END::DOUBLE AS score FROM i a JOIN i b ON a.cluster_id = b.cluster_id AND b.m = 1),
w AS (SELECT *, count(*) FILTER (score >= 0.15) OVER (PARTITION BY cluster_id) AS ok, count(*) FILTER (score >= 0.15) OVER (PARTITION BY cluster_id ORDER BY m) AS bf, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, m) AS rk, count(*) OVER (PARTITION BY cluster_id) AS n FROM s)
SELECT cluster_id::BIGINT AS cluster_id, CASE WHEN ok >= 2 THEN bf - 1 ELSE rk - 1 END AS member_idx, item_id, round(score, 6) AS score FROM w WHERE n >= 2 AND CASE WHEN ok >= 2 THEN score >= 0.15 ELSE rk <= 2 END"""


def merge_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved analyses of even ids and new ones of every third: the new ones count."""
    found = base._analyses(spark, sf_dir).withColumnRenamed("first_member", "cluster_id")
    return analyze.merge(found.filter("cluster_id % 2 = 0"), found.filter("cluster_id % 3 = 0").withColumn("complexity", F.lit("medium"))).select("cluster_id", "worth_refactoring", "complexity")


MERGE_ANALYSES = """
SELECT doc_id AS cluster_id, max(quality) = 1 AS worth_refactoring, CASE WHEN doc_id % 3 = 0 THEN 'medium' WHEN max(toxic) = 1 THEN 'high' ELSE 'low' END AS complexity
FROM labels WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY doc_id"""


def analyze_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts for groups of equal documents, answered by the template and read."""
    found, _ = analyze.analyze(base._prompted(spark, sf_dir))
    return found.select("cluster_id", "commonality", "abstraction", "suggested_name", "complexity", "worth_refactoring")


ANALYZE_WHOLE = f"""WITH {base.NUMBERED},
o AS (SELECT cluster_id, size, file_path, lang, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS r FROM m JOIN numbered USING (cluster)),
g AS (SELECT cluster_id, max(size) AS size, count(DISTINCT file_path) AS files, arg_min(lang, r) AS lang FROM o WHERE r <= 3 GROUP BY cluster_id)
SELECT cluster_id, size || ' regions of ' || lang || ' in ' || files || ' shown files have nearly the same text.' AS commonality,
  CASE WHEN files > 1 THEN 'Move the shared lines into one function that all these places call.' ELSE 'The regions lie in one file, close to each other, where merging saves little.' END AS abstraction,
  CASE WHEN files > 1 THEN 'sharedUtility' ELSE 'n/a' END AS suggested_name, CASE WHEN files > 1 THEN 'low' ELSE 'n/a' END AS complexity, files > 1 AS worth_refactoring FROM g"""


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the Markdown report on groups of equal documents."""
    lines = report.markdown_report(report.collect(*base._reported(spark, sf_dir)), "tree", 0.8).split("\n")
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines, 1)], "line_no long, line string")


#: Lines of each cluster joined; then those of the whole report.
REPORT_MARKDOWN = f"""WITH {base.NUMBERED},
mem AS (SELECT cluster_id, file_path, n, text, lang, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS r FROM m JOIN numbered USING (cluster)),
places AS (SELECT cluster_id, string_agg('| `' || file_path || ':1-' || n || '` | block | - |', chr(10) ORDER BY r) AS places FROM mem GROUP BY cluster_id),
rep AS (SELECT cluster_id, file_path AS title, coalesce(lang, '') AS lang, CASE WHEN contains(text, '```') THEN '````' ELSE '```' END AS fence, array_to_string({base.LINES}[1:20], chr(10)) || CASE WHEN n > 20 THEN chr(10) || '...' ELSE '' END AS code FROM mem WHERE r = 1),
b AS (SELECT k.*, title, round(similarity * 100)::INT || '%' AS p, concat_ws(chr(10), '', '<a id="cluster-' || cluster_id || '"></a>', '## Cluster ' || cluster_id || ': ' || title, '',
  'Similarity ' || round(similarity * 100)::INT || '%, ' || file_count || ' files, ' || size || ' regions, about ' || total_lines || ' lines', '', '| Place | Type | Name |', '| --- | --- | --- |', places, '', fence || lang, code, fence) AS block
  FROM numbered k JOIN places USING (cluster_id) JOIN rep USING (cluster_id)),
whole AS (SELECT concat_ws(chr(10), '# Similar code', '', '**Folder:** `tree`  ', '**Threshold:** 80%  ', '**Clusters:** ' || count(*) || '  ', '**Lines alike:** about ' || coalesce(sum(total_lines), 0), '', '## Contents', '',
  string_agg('- [Cluster ' || cluster_id || ': ' || title || '](#cluster-' || cluster_id || ') (' || p || ')', chr(10) ORDER BY cluster_id), string_agg(block, chr(10) ORDER BY cluster_id)) || chr(10) AS t FROM b)
SELECT unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no, unnest(string_split(t, chr(10))) AS line FROM whole"""

LANGUAGES = sorted(CASES)
SQL = {
    chunk_max: CHUNK_MAX, scan_tree: _scan_sql(), path_language: PATH_LANGUAGE, vector_distance: VECTOR_DISTANCE, yes_probability: YES_PROBABILITY, score_answers: SCORE_ANSWERS,
    rerank_stats: RERANK_STATS, rerank_whole: RERANK_WHOLE, merge_analyses: MERGE_ANALYSES, analyze_whole: ANALYZE_WHOLE, report_markdown: REPORT_MARKDOWN,
}


def queries() -> dict:
    """Name -> function of (spark, sf_dir)."""
    return {f.__name__: f for f in [*map(_chunks_of, LANGUAGES), *SQL]}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL; the chunks of fixed sources and the scanned files are stated as rows."""
    return {f"chunk_{x}": _chunks_sql(x) for x in LANGUAGES} | {f.__name__: sql for f, sql in SQL.items()}
