"""Fixed schemas of the corpus tables and the closed vocabularies they carry."""
from pyspark.sql import types as T

# Accepted words of the graph tables.
NODE_KINDS = ["repository", "module", "file", "symbol", "external"]
EDGE_KINDS = ["contains", "imports", "reexports", "references", "calls"]
RESOLUTIONS = ["structural", "resolved"]
BLOCK_KINDS = ["fact", "inference", "unknown"]
CODE_LANGUAGES = ["javascript", "typescript", "python", "java"]

# Snapshot limits.
MAX_FILES = 2000
MAX_TEXT_BYTES = 25 * 1024 * 1024
MAX_FILE_BYTES = 512 * 1024
MAX_EXPANDED_BYTES = 500 * 1024 * 1024
MAX_ENTRIES = 50000
MAX_CHUNKS = 15000


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, I, L, B, D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()

FILES = _struct(analysis_id=S, file_id=S, path=S, language=S, content=S, line_count=L, redacted=B, content_hash=S, ord=L)
NODES = _struct(analysis_id=S, id=S, kind=S, name=S, path=S, file_id=S, parent_id=S, language=S, symbol_kind=S,
                start_line=I, end_line=I, start_byte=L, end_byte=L, signature=S, exported=B, tags=T.ArrayType(S), ord=L)
EDGES = _struct(analysis_id=S, id=S, source=S, target=S, kind=S, file_id=S, start_line=I, end_line=I, specifier=S,
                resolution=S, type_only=B, dynamic=B, ord=L)
REGIONS = _struct(analysis_id=S, file_id=S, symbol_id=S, kind=S, start_line=I, end_line=I, signature=S)
CHUNKS = _struct(analysis_id=S, id=S, file_id=S, path=S, language=S, symbol_id=S, symbol=S, kind=S, start_line=I,
                 end_line=I, text=S, embedding_text=S, input_hash=S, embedding_config=S, ord=L)
JOBS = _struct(id=S, analysis_id=S, status=S, heartbeat_at=T.TimestampNTZType(), next_attempt_at=T.TimestampNTZType(),
               cancel_requested=B)
COMMIT_JSON = _struct(sha=S, commit=_struct(message=S, author=_struct(name=S, date=S), committer=_struct(name=S, date=S)))
CHANGED_FILE_JSON = _struct(filename=S, previous_filename=S, status=S, additions=L, deletions=L, patch=S)
PULL_JSON = _struct(number=L, title=S, user=_struct(login=S), state=S, merged_at=S, draft=B, updated_at=S,
                    base=_struct(ref=S, sha=S), head=_struct(ref=S, sha=S), html_url=S)
