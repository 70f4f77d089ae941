"""Schemas of the stored tables: commits, chunks of source files, pull requests and the edges between files."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
WORDS = T.ArrayType(S, False)
VECTOR = T.ArrayType(T.FloatType(), False)


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


COMMITS = table(hash=S, author=S, date=T.TimestampType(), message=S, file_path=S, condensed_diff=S, files_changed=WORDS, vector=VECTOR)
CHUNKS = table(file_path=S, language=S, start_line=I, end_line=I, content=S, is_summary=B, functions=WORDS, classes=WORDS, imports=WORDS, exports=WORDS, vector=VECTOR)
PULLS = table(pr_number=I, title=S, description=S, state=S, author=S, merged_by=S, created_at=T.TimestampType(), merged_at=T.TimestampType(), linked_issues=WORDS, resolved_by=S, vector=VECTOR)
EDGES = table(
    caller_file=S, caller_name=S, callee_file=S, callee_name=S, line=I, edge_type=S, weight=D, raw_count=T.LongType(),
    latest_hash=S, latest_date=T.TimestampType(), earliest_hash=S, earliest_date=T.TimestampType(),
)
#: One symbol of a file: a function, class, method, import, import name, export or call.
SYMBOLS = table(file_path=S, kind=S, name=S, owner=S, start_line=I, end_line=I, ord=I)
EXTERNAL = "<external>"
