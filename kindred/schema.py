"""Schemas of the tables that stages hand on."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()

CHUNK = _struct(file_path=_S, start_line=_I, end_line=_I, content=_S, language=_S, chunk_type=_S, name=_S, context=_S, chunker_used=_S)
EMBEDDED = StructType([*CHUNK, *_struct(key=_L, chunk_id=_S, embed_text=_S, embedding=ArrayType(FloatType()))])
CLUSTER = _struct(cluster_id=_L, similarity=_D, size=_L, file_count=_L, total_lines=_L, representative=_L, first_member=_L)
MEMBER = StructType([*EMBEDDED, *_struct(cluster_id=_L, member_idx=_L)])
RERANK_STATS = _struct(cluster_id=_L, original_size=_L, min_score=_D, max_score=_D, filtered_size=_L, filter_rate=_D)
ANALYSIS = _struct(cluster_id=_L, commonality=_S, abstraction=_S, suggested_name=_S, complexity=_S, worth_refactoring=BooleanType())
CACHE = _struct(file_path=_S, chunk_hash=_S, embedding=ArrayType(FloatType()), created_at=TimestampType(), model_id=_S)


def conforms(df, schema: StructType) -> bool:
    """Whether ``df`` has the columns of ``schema`` with their types; it may have more."""
    own = {f.name: f.dataType for f in df.schema}
    return all(own.get(f.name) == f.dataType for f in schema)
