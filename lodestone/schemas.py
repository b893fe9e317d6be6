"""Fixed schemas and behaviour constants."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = "source_path string, file_name string, ext string, content string"


def _struct(fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(" ") for x in fields.split(", "))])


CHUNK = _struct(
    "text string, file_name string, section_title string, start_line int, end_line int, math_density double, source_path string, "
    "chunk_id string, chunk_type string, language string, symbol_name string, symbol_type string, parent_id string, summary string, "
    "hypothetical_questions strings"
)
INDEX_ENTRY = _struct("concept string, file_name string, file_path string, start_line int, end_line int, entry_type string")
#: What a search returns beside the score; hypothetical_questions shape the vector only.
PAYLOAD = [f for f in CHUNK.fieldNames() if f != "hypothetical_questions"]
SPAN = "struct<file:string,symbol:string,type:string,start_line:int,end_line:int>"
GOLDEN = f"corpus_dir string, queries array<struct<id:string,query:string,tool:string,decisive_spans:array<{SPAN}>,supportive_spans:array<{SPAN}>>>"
TOOLS = ["search_code", "search_documents", "lookup_index"]
ENRICHMENT = "struct<chunks:array<struct<id:int,summary:string,hypothetical_questions:array<string>>>>"

# Sizes, caps and defaults that results depend on.
MIN_LINES, MAX_LINES = 20, 100
CODE_MIN_LINES, CODE_MAX_LINES = 5, 150
TOP_K, TOP_K_CAP = 5, 20
RESULT_CHARS, PARENT_CHARS, LOOKUP_SHOWN = 2000, 3000, 10
PROMPT_CHARS, ENRICH_LEAST_LINES, ENRICH_BATCH, EMBED_BATCH = 2000, 3, 10, 10
WINDOW_LINES, WHOLE_FILE, WHOLE_FILE_CHARS = 40, 10**9, 12_000
EVAL_K = (3, 5, 7, 10)
DECISIVE, SUPPORTIVE = 2, 1
VECTOR_SIZE = 4096
CANARY = "whole-file (canary)"

#: Concept lookups of one evaluation at most; they are sent to every task.
MOST_LOOKUPS = 10_000
