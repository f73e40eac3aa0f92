"""Table schemas of the data model (files -> units -> suggestions -> mapping -> rewritten files)."""

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
ARR = T.ArrayType(T.StringType())


def _st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


FILE = _st(("path", S), ("rel_path", S), ("ext", S), ("text", S))
# code unit: one method, constructor or member-less type (``unit_order`` is numeric or a struct)
UNIT = _st(("file", S), ("pkg", S), ("class_name", S), ("outer", S), ("class_fqn", S), ("method_name", S),
           ("param_types", ARR), ("qualified_signature", S), ("decl", S), ("code", S), ("strings", ARR),
           ("unit_kind", S))
SUGGESTION = _st(("batch_id", L), ("pos", L), ("kind", S), ("old", S), ("new", S))
MAPPING = _st(("kind", S), ("old_key", S), ("new_name", S), ("prio", L))
FOLDER = _st(("folder", S), ("parent", S), ("pkg", S), ("leaf", S))
DOC_ITEM = _st(("file", S), ("start", I), ("end", I), ("block", S), ("indent", S))
OCCURRENCE = _st(("file", S), ("start", I), ("end", I), ("kind", S), ("old_key", S))
LEDGER = _st(("rel_path", S))
REPLY = _st(("batch_id", L), ("reply", S), ("error", S), ("attempts", I))
