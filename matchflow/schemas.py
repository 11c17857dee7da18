"""Table layouts, as DDL strings, and the boundary between records and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPERIENCE = "array<struct<company:string,title:string,dates:string,description:array<string>>>"
EDUCATION = "array<struct<institution:string,degree:string,field:string,dates:string,gpa:string>>"
PROJECTS = "array<struct<name:string,technologies:array<string>,description:array<string>,url:string>>"

POSTINGS = (
    "id bigint, job_title string, company string, location string, description string, "
    "apply_url string, description_hash string, source_url string, metadata string, "
    "created_at timestamp, description_embedding array<float>"
)
PROFILES = (
    "id bigint, full_name string, email string, phone string, location string, summary string, "
    f"skills array<string>, experience {EXPERIENCE}, education {EDUCATION}, projects {PROJECTS}, "
    "raw_text string, file_hash string, metadata string, created_at timestamp, "
    "updated_at timestamp, summary_embedding array<float>"
)
ANALYSIS = (
    "id bigint, profile_id bigint, posting_id bigint, match_score decimal(5,2), "
    "matching_skills array<string>, missing_skills array<string>, "
    "keyword_suggestions array<string>, improvement_suggestions array<string>, "
    "analysis_metadata string, created_at timestamp"
)
SECTION_VECTORS = (
    "profile_id bigint, section_type string, section_index int, content_hash string, "
    "embedding array<float>, created_at timestamp"
)
REWRITE_CACHE = "cache_key string, response_text string, created_at timestamp"

# Text columns that are never null, and what a missing one becomes.
_TEXT_DEFAULTS = {"description", "raw_text"}
_METADATA = {"metadata"}


def _default(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, (T.StructType, T.StringType)
    ):
        return F.array().cast(field.dataType)
    if field.name in _TEXT_DEFAULTS:
        return F.lit("")
    if field.name in _METADATA:
        return F.lit("{}")
    return F.lit(None).cast(field.dataType)


def conform(df: DataFrame, layout: str) -> DataFrame:
    """``df`` with exactly the columns of ``layout``; missing or null values take the defaults.

    This is the boundary where records become rows: a bare string where a list of strings is
    expected becomes a list of one, unknown columns are dropped.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in T.StructType.fromDDL(layout).fields:
        default = _default(field)
        if field.name not in have:
            out.append(default.alias(field.name))
            continue
        value = F.col(field.name)
        wants_list = isinstance(field.dataType, T.ArrayType)
        if wants_list and isinstance(have[field.name], T.StringType):
            value = F.when(value.isNotNull(), F.array(value))
        out.append(F.coalesce(value.cast(field.dataType), default).alias(field.name))
    return df.select(*out)


def from_json_records(df: DataFrame, json_col: str, layout: str) -> DataFrame:
    """JSON records to typed rows; unreadable fields are null before the defaults apply."""
    parsed = df.select(F.from_json(F.col(json_col), layout).alias("r")).select("r.*")
    return conform(parsed, layout)


def to_json_records(df: DataFrame, json_col: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(json_col))
