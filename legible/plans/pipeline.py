"""L6 as written stages: every stage is a table, a state row says that it is complete, a restart goes on behind the last one.

Layout below ``root``: ``<version>/<stage>/`` (parquet) and ``state/`` (one row per finished stage: stage, version, rows,
elapsed_s, finished_at).  ``version`` is a digest of the input's rows and of the options, so other input or other options
never meet old tables.  A stage counts as finished once its state row is there; a stage that was cut off is written anew,
and model replies are kept below ``<version>/replies``, so it asks only what has no reply yet.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legible.operators import extract as E
from legible.operators.rewrite import rename_files_for_types
from legible.plans import jobs as J

STATE = "stage string, version string, n_rows bigint, elapsed_s double, finished_at timestamp"


def input_version(files: DataFrame, opts: J.Options, key: str = "rel_path") -> str:
    """Digest of the rows (in any order) and of the options; a provider counts by its class."""
    n, a, b = files.select(F.xxhash64(key, "text").alias("h"), F.crc32(F.concat_ws("\x1f", key, "text").cast("binary")).alias("c")).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.sum("c")).first()

    def plain(v):
        return type(v).__name__ if callable(v) else repr(v)
    told = [(f.name, plain(getattr(opts, f.name))) for f in fields(opts) if f.name != "replies_path"]
    return hashlib.sha256(repr((n, str(a), str(b), told)).encode()).hexdigest()[:16]


@dataclass
class Stages:
    """The stage tables of one version."""
    spark: SparkSession
    root: str
    version: str

    def path(self, name: str) -> str:
        return "%s/%s/%s" % (self.root.rstrip("/"), self.version, name)

    def state(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root.rstrip("/") + "/state")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(at.toString()).filter(F.col("version") == self.version)

    def run(self, name: str, make, needed: bool = True) -> DataFrame:
        """The stage's table: read if it is finished, else made, written and entered.  An empty needed stage is an error."""
        done = self.state().filter(F.col("stage") == name).limit(1).count() > 0
        if not done:
            began = time.time()
            make().write.mode("overwrite").parquet(self.path(name))
            out = self.spark.read.parquet(self.path(name))
            n = out.count()
            if needed and not n:
                raise RuntimeError("stage %s produced no rows" % name)
            row = self.spark.range(1).select(
                F.lit(name).alias("stage"), F.lit(self.version).alias("version"), F.lit(n).cast("bigint").alias("n_rows"),
                F.lit(time.time() - began).alias("elapsed_s"), F.current_timestamp().alias("finished_at"))
            row.write.mode("append").parquet(self.root.rstrip("/") + "/state")
        return self.spark.read.parquet(self.path(name))


def pipeline_job(files: DataFrame, root: str, opts: J.Options = J.Options(), key: str = "rel_path") -> dict:
    """analyze -> suggest -> apply (A13 included) -> [package refactor] -> annotate over ``files`` (``rel_path``, ``text``).

    Returns the stage tables and ``state`` (one row per stage).  ``root`` is a folder that every executor reaches."""
    st = Stages(files.sparkSession, root, input_version(files, opts, key))
    opts = replace(opts, replies_path=opts.replies_path or st.path("replies"))
    files = files.select(F.col(key).alias("rel_path"), "text")
    decls = st.run("declarations", lambda: E.java_declarations(J.included(files, opts)))
    units = st.run("units", lambda: E.java_units(decls, flat_names=opts.flat_names))
    mapping = st.run("mapping", lambda: J.suggest_job(units, opts))

    def apply():
        done = J.apply_job(J.included(files, opts), mapping, "rel_path")
        return rename_files_for_types(done, decls, mapping)
    applied = st.run("applied", apply)
    current = applied.select(F.col("new_path").alias("rel_path"), F.col("new_text").alias("text"))
    out = {"declarations": decls, "units": units, "mapping": mapping, "applied": applied}
    if opts.refactor_packages:
        name = F.substring_index("rel_path", "/", -1)
        parts = current.select("rel_path", "text", F.regexp_replace("rel_path", "/?[^/]*$", "").alias("folder"), name.alias("file_name"),
                               F.regexp_replace(name, "\\.[^.]*$", "").alias("name"))
        moved = st.run("packages", lambda: J.package_refactor_job(parts, opts=opts)[0])
        current = moved.select(F.col("new_path").alias("rel_path"), F.col("new_text").alias("text"))
        out["packages"] = moved
    again = st.run("new_declarations", lambda: E.java_declarations(current))
    out["documented"] = st.run("documented", lambda: J.annotate_job(current, again, opts))
    out["rejects"] = decls.filter(F.col("unit_kind") == "error").select("file", "error")
    out["state"] = st.state()
    return out

