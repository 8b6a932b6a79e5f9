"""Analysis of clusters by a generating model: prompt, answer, validation.

The generator built in answers from the facts in the prompt, so that the whole
path runs without a model.  An answer that can't be read is a null analysis.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from kindred.functions.text import cut

SYSTEM = "You review code that looks alike. Say in JSON what the regions share (commonality), whether merging them pays (worth_refactoring, true or false), how to merge them or why not to (abstraction), a name for the shared code (suggested_name) and the effort (complexity: low, medium or high). Answer with the JSON object alone."
ASK = "Judge whether and how to merge these regions."
REGIONS, REGION_CHARS, SHORTEST = 3, 600, 20
NONE_LIKE = ("n/a", "na", "none", "")
ANALYSIS = StructType([StructField(c, StringType()) for c in ("commonality", "abstraction", "suggested_name", "complexity")] + [StructField("worth_refactoring", BooleanType())])


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class TemplateGenerator:
    """Answers from what the prompt says: number of regions, files, language."""

    def generate(self, prompt: str) -> str:
        n = re.search(r"(\d+) code regions look alike", prompt)
        paths = set(re.findall(r"Region \d+: (.*) \(lines \d+-\d+\)", prompt))
        language = re.search(r"```(\w+)", prompt)
        worth = len(paths) > 1
        answer = {
            "commonality": f"{n[1] if n else 'Several'} regions of {language[1] if language else 'code'} in {len(paths)} shown files have nearly the same text.",
            "worth_refactoring": worth,
            "abstraction": "Move the shared lines into one function that all these places call." if worth else "The regions lie in one file, close to each other, where merging saves little.",
            "suggested_name": "sharedUtility" if worth else "n/a",
            "complexity": "low" if worth else "n/a",
        }
        return json.dumps(answer)[2:]


def prompts(members: DataFrame) -> DataFrame:
    """(cluster_id, prompt) from the first three regions of each cluster and the number of the others.

    ``members``: cluster_id, member_idx, file_path, start_line, end_line, language, content.
    """
    newline = F.lit("\n")
    sized = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    shown = members.filter(F.col("member_idx") < REGIONS)
    region = F.concat(
        F.lit("Region "), (F.col("member_idx") + 1).cast("string"), F.lit(": "), "file_path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n```"), "language", newline,
        cut(F.col("content"), REGION_CHARS, "\n// ... (truncated)"), F.lit("\n```\n"),
    )
    regions = shown.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_idx", region.alias("r")))), lambda x: x["r"]), "\n").alias("regions"))
    rest = F.when(F.col("size") > REGIONS, F.concat(F.lit("\n(Plus "), (F.col("size") - REGIONS).cast("string"), F.lit(" more similar regions)\n"))).otherwise("")
    text = F.concat(
        F.lit(f"<|im_start|>system\n{SYSTEM}\n<|im_end|>\n<|im_start|>user\n"), F.col("size").cast("string"), F.lit(" code regions look alike.\n\n"), "regions", rest,
        F.lit(f"\n{ASK}\n<|im_end|>\n<|im_start|>assistant\n{{\""),
    )
    return regions.join(sized, "cluster_id").select("cluster_id", text.alias("prompt"))


def read_answer(output: str | None) -> dict | None:
    """The analysis in a model's answer, or None.

    The answer may go on from the ``{"`` that the prompt ends with, think
    first, or be fenced.  The first object counts, by depth of braces.
    """
    raw = (output or "").strip()
    if not raw.startswith("{"):
        raw = '{"' + raw
    raw = raw.rpartition("</think>")[2].strip()
    fenced = re.search(r"```(?:json)?(.*?)(?:```|\Z)", raw, re.S)
    raw = fenced[1].strip() if fenced else raw
    depth, start = 0, raw.find("{")
    for m in re.finditer(r"[{}]", raw[start:] if start >= 0 else ""):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            try:
                return validate(json.loads(raw[start : start + m.end()]))
            except ValueError:
                return None
    return None


def validate(data: dict) -> dict | None:
    text = {k: data.get(k, d) for k, d in (("commonality", ""), ("abstraction", ""), ("suggested_name", ""), ("complexity", "medium"))}
    if not all(isinstance(v, str) for v in text.values()):
        return None
    text = {k: v.strip() for k, v in text.items()}
    if min(len(text["commonality"]), len(text["abstraction"])) < SHORTEST:
        return None
    worth = data.get("worth_refactoring", True)
    worth = worth if isinstance(worth, bool) else worth.lower() in ("true", "yes", "1") if isinstance(worth, str) else True
    effort = text["complexity"].lower()
    if effort in NONE_LIKE:
        effort = "medium" if worth else "n/a"
    elif effort not in ("low", "medium", "high"):
        effort = "medium"
    if text["suggested_name"].lower() in NONE_LIKE:
        text["suggested_name"] = "sharedUtility" if worth else "n/a"
    return text | {"complexity": effort, "worth_refactoring": worth}


@F.pandas_udf(ANALYSIS)
def _parse(output: pd.Series) -> pd.DataFrame:
    rows = [read_answer(x) for x in output]
    return pd.DataFrame([[None] * 5 if r is None else [r[f.name] for f in ANALYSIS] for r in rows], columns=ANALYSIS.names)


def parse(answers: DataFrame, output: str = "output") -> DataFrame:
    """``answers`` with ``analysis``: a struct, with null fields where the answer can't be read."""
    return answers.withColumn("analysis", _parse(output))


def pending(clusters: DataFrame, analyses: DataFrame, most: int | None = None) -> DataFrame:
    """Clusters without an analysis, the first ``most`` by id."""
    out = clusters.join(analyses.select("cluster_id"), "cluster_id", "left_anti")
    return out if most is None else out.orderBy("cluster_id").limit(most)


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All analyses; where both have a cluster the new one counts."""
    return existing.join(new.select("cluster_id"), "cluster_id", "left_anti").unionByName(new)


def analyze(members: DataFrame, generator: Generator | None = None, parallel: int = 0) -> tuple[DataFrame, DataFrame]:
    """(analyses: cluster_id and the fields of ANALYSIS; failed: cluster_id).

    ``parallel``: tasks that the prompts are dealt to; 0 leaves that to Spark.
    """
    generator = generator or TemplateGenerator()

    @F.pandas_udf(StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(generator.generate)

    asked = prompts(members)
    asked = asked.repartition(parallel, "cluster_id") if parallel > 0 else asked
    answers = parse(asked.withColumn("output", generate("prompt")))
    good = F.col("analysis.commonality").isNotNull()
    return answers.filter(good).select("cluster_id", "analysis.*"), answers.filter(~good).select("cluster_id")
