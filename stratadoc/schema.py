"""Schemas of the canonical tables, as DDL, and checks that their rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<l:double,t:double,r:double,b:double>"
CELLS = "array<struct<row_index:int,col_index:int,text:string,is_header:boolean>>"
LOCATION = (
    "struct<type:string,num:int,sheet:string,row:int,ref:string,index:int,page_id:string,document_id:string,revision_id:string,source_type:string,extractor_route:string,route:string,"
    "quality_score:double,strategy:string,block_ids:array<string>,kind:string>"
)
CHUNKS = f"chunk_id string, text string, lang string, tenant_id string, source string, source_type string, location {LOCATION}, acl_groups array<string>"
POINTS = f"{CHUNKS}, point_id string, vector array<float>, ingest_seq bigint"
MANIFESTS = "document_id string, revision_id string, tenant_id string, source_name string, source_type string, source_sha256 string, file_size_bytes bigint, mime_type string, total_pages int, parser_name string, parser_version string, created_at timestamp, metadata map<string,string>"
BLOCKS = f"page_id string, block_id string, block_type string, reading_order int, layer string, route string, bbox {BOX}, confidence double, quality_score double, text string, rows array<array<string>>"
PAGES = (
    "document_id string, revision_id string, page_id string, page_index int, page_number int, page_type string, processing_status string, native_text string, ocr_text string, index_text string, selected_route string,"
    " gate_passed boolean, decision_quality double, decision_agreement double, candidate_count int, n_fallbacks int, errors array<string>, warnings array<string>"
)
JOBS = "document_id string, source string, tenant_id string, chunks bigint, status string, ingest_seq bigint"

# What enumerations allow.
PAGE_TYPES = ("digital", "scanned", "mixed", "empty", "unknown")
ROUTES = ("native", "full_page_ocr", "region_ocr", "combined", "rejected")
STATUSES = ("accepted", "needs_review", "failed")
BLOCK_TYPES = ("heading", "paragraph", "list_item", "table", "key_value", "image_text", "header", "footer", "caption", "unknown")
# What public metadata and messages must not have.
#: Metadata keys that hold secrets, or copies of the text.
SECRET_KEYS = ("api_key", "authorization", "connection_string", "password", "secret", "secret_key", "token", "access_token")
TEXT_KEYS = ("candidate_text", "content", "document_text", "native_text", "ocr_text", "text", "text_preview")
#: Private paths and values of secrets in messages.
PRIVATE_PATH = r"(?i)(?:[A-Za-z]:[\\/]|(?<![\w:])/(?:Users|home|var|tmp|app|data)/)"
SECRET_VALUE = r"(?i)(?:password|secret|access[_-]?token|api[_-]?key)\s*[:=]"
ABSOLUTE = r"^(?:/|[A-Za-z]:[\\/]|\\\\)"


def allowed(column: str, values: tuple[str, ...]) -> Column:
    return F.when(F.col(column).isNotNull() & ~F.col(column).isin(*values), F.concat(F.lit(f"{column}:"), F.col(column)))


def metadata_faults(metadata: Column) -> Column:
    """Names of what public metadata mustn't have: secrets, copies of the text, absolute paths."""
    keys = F.transform(F.map_keys(metadata), lambda k: F.translate(F.lower(F.trim(k)), "-", "_"))
    faults = F.array(
        F.when(F.exists(keys, lambda k: k.isin(*SECRET_KEYS)), "secret_field"), F.when(F.exists(keys, lambda k: k.isin(*TEXT_KEYS)), "text_copy"),
        F.when(F.exists(F.map_values(metadata), lambda v: v.rlike(ABSOLUTE)), "absolute_path"),
    )
    return F.filter(faults, lambda f: f.isNotNull())


_JSON_STRING = r'"((?:[^"\\]|\\.)*)"'


def json_faults(metadata: Column) -> Column:
    """metadata_faults of nested metadata, given as JSON: keys and strings at any depth."""
    named = F.transform(F.regexp_extract_all(metadata, F.lit(_JSON_STRING + r"\s*:"), F.lit(1)), lambda k: F.translate(F.lower(F.trim(k)), "-", "_"))
    values = F.regexp_extract_all(F.regexp_replace(metadata, _JSON_STRING + r"\s*:", ""), F.lit(_JSON_STRING), F.lit(1))
    plain_ = F.transform(values, lambda v: F.replace(F.replace(v, F.lit("\\\\"), F.lit("\\")), F.lit("\\/"), F.lit("/")))
    faults = F.array(
        F.when(F.exists(named, lambda k: k.isin(*SECRET_KEYS)), "secret_field"), F.when(F.exists(named, lambda k: k.isin(*TEXT_KEYS)), "text_copy"),
        F.when(F.exists(plain_, lambda v: v.rlike(ABSOLUTE)), "absolute_path"),
    )
    return F.filter(faults, lambda f: f.isNotNull())


def message_faults(messages: Column) -> Column:
    """Names of what public messages mustn't have."""
    faults = F.array(F.when(F.exists(messages, lambda m: m.rlike(PRIVATE_PATH)), "private_path"), F.when(F.exists(messages, lambda m: m.rlike(SECRET_VALUE)), "secret_value"))
    return F.filter(faults, lambda f: f.isNotNull())


def table_faults(blocks: DataFrame) -> DataFrame:
    """Blocks where a table has no rows, something else has, or the box is no box."""
    c = F.col
    box = c("bbox").isNotNull() & ~((c("bbox.l") >= 0) & (c("bbox.t") >= 0) & (c("bbox.r") > c("bbox.l")) & (c("bbox.b") > c("bbox.t")))
    faults = F.array(F.when((c("block_type") == "table") & c("rows").isNull(), "table_without_rows"), F.when((c("block_type") != "table") & c("rows").isNotNull(), "rows_without_table"), F.when(box, "box"), allowed("block_type", BLOCK_TYPES))
    return blocks.withColumn("fault", F.explode(F.filter(faults, lambda f: f.isNotNull())))


def checked(df: DataFrame, faults: Column) -> DataFrame:
    """df; a row with a fault raises when it is read."""
    return df.where(F.when(F.size(faults) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("contract: "), F.array_join(faults, ", "))).cast("boolean")))
