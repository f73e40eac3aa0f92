"""File-tree scans, JSON readers, sinks and the resume ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from legible.functions import text as T

SNIPPET_SCHEMA = Ty.StructType([
    Ty.StructField("file", Ty.StringType()), Ty.StructField("pkg", Ty.StringType()),
    Ty.StructField("classFqn", Ty.StringType()), Ty.StructField("className", Ty.StringType()),
    Ty.StructField("methodName", Ty.StringType()), Ty.StructField("paramTypes", Ty.ArrayType(Ty.StringType())),
    Ty.StructField("qualifiedSignature", Ty.StringType()), Ty.StructField("decl", Ty.StringType()),
    Ty.StructField("code", Ty.StringType()), Ty.StructField("strings", Ty.ArrayType(Ty.StringType())),
])
MAPPING_KINDS = {"simple": "simple", "classFqn": "class", "fieldFqn": "field", "methodSig": "method"}
MAPPING_SCHEMA = Ty.StructType([Ty.StructField(k, Ty.MapType(Ty.StringType(), Ty.StringType()))
                                for k in MAPPING_KINDS])


def normalize_exts(exts: list[str]) -> list[str]:
    return [(e if e.startswith(".") else "." + e).lower() for e in exts]


# S1 + S2 + S3 + S6
def scan_files(spark: SparkSession, root: str, exts: list[str] = (".java",), exclude_globs: list[str] = ()) -> DataFrame:
    """Recursive scan: ``path, rel_path, ext, text`` (whole file, UTF-8); unreadable files and files that are not
    UTF-8 are skipped (see :func:`scan_rejects`)."""
    df = _scan(spark, root, exts, exclude_globs)
    return df.filter(F.is_valid_utf8("text")).select("path", "rel_path", "ext", "text")


def scan_rejects(spark: SparkSession, root: str, exts: list[str] = (".java",), exclude_globs: list[str] = ()) -> DataFrame:
    """Files of the scan whose bytes are not UTF-8: ``path, rel_path, ext, error``."""
    df = _scan(spark, root, exts, exclude_globs)
    return df.filter(~F.is_valid_utf8("text")).select("path", "rel_path", "ext", F.lit("not UTF-8").alias("error"))


def ext_glob(exts: list[str]) -> str:
    """A listing glob for a set of extensions in any case, so other files' bytes are never read."""
    one = ["".join("[%s%s]" % (c.lower(), c.upper()) if c.isalpha() else c for c in e) for e in normalize_exts(list(exts))]
    return "*" + one[0] if len(one) == 1 else "*{%s}" % ",".join(one)


def _scan(spark: SparkSession, root: str, exts: list[str], exclude_globs: list[str]) -> DataFrame:
    # binaryFile yields exactly one row per file (empty files included) with its path
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
          .option("ignoreCorruptFiles", True).option("pathGlobFilter", ext_glob(exts)).load(root))
    df = df.select(F.col("path"), F.col("content").cast("string").alias("text"))
    df = df.withColumn("rel_path", T.relative_path("path", root)).withColumn("ext", T.ext_of("rel_path"))
    if exclude_globs:
        df = df.filter(~T.excluded_by("rel_path", list(exclude_globs)))
    return df


# S4
#: fields beside the interchange ones: they make the table fit the next stage without a guess
SNIPPET_EXTRA = Ty.StructType([Ty.StructField("unitKind", Ty.StringType()), Ty.StructField("outer", Ty.StringType()),
                               Ty.StructField("ordinal", Ty.IntegerType())])
SNIPPET_NAMES = {"classFqn": "class_fqn", "className": "class_name", "methodName": "method_name", "paramTypes": "param_types",
                 "qualifiedSignature": "qualified_signature"}


def read_snippets(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Snippet file -> the unit table that ``suggest_job`` reads.

    One JSON object a line (``write_snippets``) is read in splits.  ``multi_line`` reads the interchange form, one JSON array,
    whose file Spark parses in one task: a bounded import.  Files without the extra fields get the kind from the names
    (no method name: class; the class's name: constructor) and the order of the file."""
    raw = spark.read.schema(Ty.StructType(SNIPPET_SCHEMA.fields + SNIPPET_EXTRA.fields)).option("multiLine", multi_line).json(path)
    u = raw.withColumnsRenamed(SNIPPET_NAMES)
    kind = F.coalesce("unitKind", F.when(F.coalesce("method_name", F.lit("")) == "", "class")
                      .when(F.col("method_name") == F.col("class_name"), "ctor").otherwise("method"))
    order = F.coalesce(F.col("ordinal").cast("bigint"), F.monotonically_increasing_id())
    return u.select("file", "pkg", "class_fqn", "class_name", F.coalesce("method_name", F.lit("")).alias("method_name"), "param_types",
                    "qualified_signature", "decl", "code", "strings", "outer", kind.alias("unit_kind"),
                    F.struct("file", order.alias("ordinal")).alias("unit_order"))


# K1
def write_snippets(units: DataFrame, path: str, fmt: str = "json", cap: int | None = None) -> None:
    """Units as a stage file: one JSON object a line with the interchange names, or parquet.  ``cap`` cuts the code."""
    code = F.col("code") if cap is None else T.truncate_text("code", cap)
    back = {v: k for k, v in SNIPPET_NAMES.items()}
    cols = [(code if c == "code" else F.col(c)).alias(back.get(c, c)) for c in (
        "file", "pkg", "class_fqn", "class_name", "method_name", "param_types", "qualified_signature", "decl", "code", "strings")]
    extra = [F.col("unit_kind").alias("unitKind"), F.col("outer") if "outer" in units.columns else F.lit(None).cast("string").alias("outer"),
             F.col("unit_order.ordinal").cast("int").alias("ordinal")]
    units.select(*cols, *extra).write.mode("overwrite").format(fmt).save(path)


# The long table is the stage file
MAPPING_TABLE = "kind string, old_key string, new_name string, prio bigint"


def write_mapping_table(mapping: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The mapping as a long table (parquet or one JSON object a line): a folder per kind, rules in ranges of their order,
    so writing and reading split however many rules there are."""
    cols = mapping.select("kind", "old_key", "new_name", F.col("prio").cast("bigint").alias("prio"))
    (cols.repartitionByRange(F.col("kind"), F.col("prio"), F.col("old_key")).sortWithinPartitions("kind", "prio", "old_key")
     .write.mode("overwrite").partitionBy("kind").format(fmt).save(path))


def read_mapping_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(MAPPING_TABLE).format(fmt).load(path).select("kind", "old_key", "new_name", "prio")


# S5
def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Import of the interchange form: one JSON object with four maps -> ``kind, old_key, new_name, prio`` (prio = position
    in its map).  Spark parses the object in one task, so this is for files of export size."""
    raw = spark.read.schema(MAPPING_SCHEMA).option("multiLine", True).json(path)
    maps = F.array(*[F.struct(F.lit(kind).alias("kind"), F.map_entries(F.coalesce(
        F.col(f), F.create_map().cast("map<string,string>"))).alias("es")) for f, kind in MAPPING_KINDS.items()])
    one = raw.select(F.inline(maps)).select("kind", F.posexplode("es").alias("prio", "e"))
    return one.select("kind", F.col("e.key").alias("old_key"), F.col("e.value").alias("new_name"), F.col("prio").cast("bigint").alias("prio"))


EXPORT_MAX_RULES = 200_000


# K2
def write_mapping(mapping: DataFrame, path: str, max_rules: int = EXPORT_MAX_RULES) -> None:
    """Bounded export of the interchange form, one JSON object with four maps (insertion order = prio).

    The object is one value, so a mapping above ``max_rules`` is refused (counted first): use ``write_mapping_table``."""
    n = mapping.count()
    if n > max_rules:
        raise ValueError("%d rules exceed the export's bound of %d; write_mapping_table has none" % (n, max_rules))
    inv = {v: k for k, v in MAPPING_KINDS.items()}
    # one row per kind (four rows); entries sorted by prio keep the insertion order
    per = mapping.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("prio", "old_key", "new_name"))).alias("xs"))
    per = per.select("kind", F.map_from_entries(F.transform("xs", lambda x: F.struct(x["old_key"], x["new_name"]))).alias("m"))
    row = per.groupBy().agg(*[F.first(F.when(F.col("kind") == k, F.col("m")), ignorenulls=True).alias(inv[k]) for k in inv])
    row.write.mode("overwrite").json(path)


# K3 + K4
def write_sources(files: DataFrame, path: str, key: str = "rel_path", text_col: str = "new_text",
                  old_col: str | None = "text", changed_only: bool = True) -> DataFrame:
    """Write rewritten texts keyed by relative path (overwrite); optionally only changed ones."""
    out = files
    if changed_only and old_col:
        out = out.filter(~F.col(text_col).eqNullSafe(F.col(old_col)))
    out.select(key, F.col(text_col).alias("text")).write.mode("overwrite").parquet(path)
    return out


# K5
def dry_run_stats(rewritten: DataFrame, text_col: str = "text") -> DataFrame:
    changed = ~F.col("new_text").eqNullSafe(F.col(text_col))
    return rewritten.agg(F.count(F.lit(1)).alias("n_files"),
                         F.sum(F.when(changed, 1).otherwise(0)).cast("bigint").alias("n_changed"),
                         F.sum("n_replacements").cast("bigint").alias("n_replacements"))


# J5 / K6
def pending_files(files: DataFrame, ledger: DataFrame, key: str = "rel_path") -> DataFrame:
    """Files not yet in the ledger (anti-join before any text is needed)."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


def append_ledger(done: DataFrame, ledger_path: str, key: str = "rel_path") -> None:
    done.select(key).write.mode("append").parquet(ledger_path)


# S7
def split_parsed(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extractor output -> (units, rejects); rejects carry ``error`` and never stop the job."""
    return units.filter(F.col("error").isNull()).drop("error"), units.filter(F.col("error").isNotNull())


# W7
def sorted_files(df: DataFrame, path_col: str = "rel_path") -> DataFrame:
    """Stable path order, applied only at a sink (a global sort is a range shuffle)."""
    return df.orderBy(path_col)
