"""Folder (package) renaming plan: U3, F3, F4, G4-G6, W5, W6, A9-A11, A15.

Input is a file table with a folder path per file (``folder``, ``/``-separated, relative to the
source root) and a class-like base name per file.  Everything is relational: leaf folders are a
left-anti join with the parents, names come from a skew-safe top-40 per folder and a partially
aggregated token count, conflicts are resolved by ranking free suffix candidates per
(parent, base) group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators.lookup import at, with_map
from legible.operators.order import dense_seq, top_k_per_group
from legible.session import checkpoint_dir, cut_lineage

# ---- fixed values that must equal the reference's behaviour ---------------------------------
SKIP_PACKAGES = "^(androidx?|com\\.google|org|kotlinx?|java|javax|sun)\\b"
MAX_CANDIDATES = 1000
NAMES_PER_FOLDER = 40
MIN_TOKEN_LEN = 3
DEFAULT_SEGMENT = "module"
FOLDERS_PER_CALL = 100
# ----------------------------------------------------------------------------------------------

def parent_of(folder) -> F.Column:
    return F.regexp_replace(T._c(folder), "/?[^/]*$", "")


def leaf_of(folder) -> F.Column:
    return F.substring_index(T._c(folder), "/", -1)


def existing_folders(files: DataFrame) -> DataFrame:
    """Every folder that exists: all ancestors of every file's folder (``folder``, ``parent``, ``name``)."""
    segs = F.split(F.col("folder"), "/")
    f = files.select("folder").distinct()
    anc = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)),
                                         lambda n: F.array_join(F.slice(segs, 1, n), "/"))).alias("folder")).distinct()
    return anc.select("folder", parent_of("folder").alias("parent"), leaf_of("folder").alias("name"))


# U3
def leaf_folders(files: DataFrame) -> DataFrame:
    """Folders holding files minus folders that have a direct child folder holding files."""
    with_files = files.select("folder").distinct()
    parents = with_files.select(parent_of("folder").alias("folder")).distinct()
    return with_files.join(parents, "folder", "left_anti")


# W5
def limit_candidates(cands: DataFrame, n: int = MAX_CANDIDATES) -> DataFrame:
    """First ``n`` candidates in path order: an operator of its own, never applied unasked."""
    return cands.orderBy("folder").limit(n)


# F3 + F4
def suspicious_folders(files: DataFrame, skip_regex: str = SKIP_PACKAGES,
                       max_candidates: int | None = None) -> DataFrame:
    """Leaf folders outside skipped packages whose leaf looks obfuscated; all of them unless ``max_candidates`` is given."""
    leaves = leaf_folders(files)
    c = leaves.select("folder", parent_of("folder").alias("parent"), T.normalize_package("folder").alias("pkg"),
                      leaf_of("folder").alias("leaf"))
    c = c.filter(~F.col("pkg").rlike(skip_regex) & T.looks_obfuscated("leaf"))
    return c if max_candidates is None else limit_candidates(c, max_candidates)


# G6
def class_names_per_folder(files: DataFrame, k: int = NAMES_PER_FOLDER) -> DataFrame:
    """First ``k`` base names per folder by name (skew-safe top-k, never a whole-folder list)."""
    return top_k_per_group(files.select("folder", "name"), ["folder"], ["name"], k).drop("rk")


# G4 + W4
def top_token_per_group(names: DataFrame) -> DataFrame:
    """Most frequent token (split on non-alphanumerics, lower case, >= 3 chars) per folder; ties by token."""
    toks = names.select("folder", F.explode(F.split(F.lower("name"), "[^A-Za-z0-9]+")).alias("token"))
    toks = toks.filter(F.length("token") >= MIN_TOKEN_LEN)
    cnt = toks.groupBy("folder", "token").agg(F.count(F.lit(1)).alias("cnt"))
    return cnt.groupBy("folder").agg(
        F.min_by(F.struct("token", "cnt"), F.struct((-F.col("cnt")).alias("n"), F.col("token").alias("t"))).alias("b")
    ).select("folder", F.col("b.token").alias("token"), F.col("b.cnt").cast("bigint").alias("cnt"))


# G5 + T7
def heuristic_segment(cands: DataFrame, files: DataFrame, k: int | None = None) -> DataFrame:
    """Segment from the top token of all names of a folder, or (parity with the reference) of its first ``k`` names."""
    names = files.join(cands.select("folder"), "folder", "left_semi").select("folder", "name")
    if k is not None:
        names = class_names_per_folder(names, k)
    top = top_token_per_group(names)
    return cands.join(top.select("folder", "token"), "folder", "left").withColumn(
        "segment", T.sanitize_segment(F.coalesce("token", F.lit(DEFAULT_SEGMENT)))).drop("token")


# W6
def resolve_name_conflicts(cands: DataFrame, existing: DataFrame, order_col: str = "folder") -> DataFrame:
    """Give each candidate (``folder, parent, segment``) a target name under its parent.

    Same (parent, segment) members take, in ``order_col`` order, the free names of the sequence
    ``seg, seg2, seg3, …`` (free = no existing sibling, the candidate's own folder included).  When
    two different segments land on one name (``foo`` + 2 = ``foo2``), the earlier candidate keeps
    it and the name is blocked for the other segment; rounds repeat until targets are unique."""
    c = cands.select("folder", "parent", F.col("segment").alias("base"), F.col(order_col).alias("_ord"))
    checkpoint_dir(cands.sparkSession)
    # members and free names are both ranked skew-safely: a (parent, base) group may be any size
    c = cut_lineage(dense_seq(c, ["parent", "base"], ["_ord"], out="k"))
    blocked = existing.select("parent", "name", F.lit(None).cast("string").alias("owner"))
    # every round settles at least one more name for good, so the loop ends
    while True:
        sizes = c.groupBy("parent", "base").agg(F.count(F.lit(1)).alias("m"))
        # a blocked name "foo12" can only collide with the sequences of "foo12", "foo1" and "foo":
        # expand it to those bases and equi-join, so a parent with many children never fans out
        digits = F.length(F.regexp_extract("name", "[0-9]*$", 0))
        keyed = blocked.select("parent", "name", "owner", F.explode(F.transform(
            F.sequence(F.lit(0), digits), lambda i: F.substring("name", 1, F.length("name") - i))).alias("base"))
        nb = (sizes.join(keyed, ["parent", "base"])
                   .filter(F.col("owner").isNull() | (F.col("owner") != F.col("base")))
                   .groupBy("parent", "base").agg(F.count(F.lit(1)).alias("b")))
        gen = sizes.join(nb, ["parent", "base"], "left").select(
            "parent", "base", F.explode(F.sequence(F.lit(1), F.col("m") + F.coalesce("b", F.lit(0)))).alias("s"))
        gen = gen.withColumn("name", F.when(F.col("s") == 1, F.col("base"))
                             .otherwise(F.concat("base", F.col("s").cast("string"))))
        bl = blocked.alias("x")
        free = gen.alias("g").join(bl, (F.col("g.parent") == F.col("x.parent")) & (F.col("g.name") == F.col("x.name"))
                                   & (F.col("x.owner").isNull() | (F.col("x.owner") != F.col("g.base"))), "left_anti")
        free = dense_seq(free.select("parent", "base", "s", "name"), ["parent", "base"], ["s"], out="k")
        # materialised once: the uniqueness check and the result read the same checkpoint
        assigned = cut_lineage(c.join(free.select("parent", "base", "k", F.col("name").alias("target")),
                                      ["parent", "base", "k"]))
        dup = (assigned.groupBy("parent", "target")
                       .agg(F.min_by("base", "_ord").alias("winner"), F.countDistinct("base").alias("nb"))
                       .filter(F.col("nb") > 1))
        if len(dup.limit(1).collect()) == 0:
            break
        blocked = blocked.unionByName(dup.select("parent", F.col("target").alias("name"), F.col("winner").alias("owner")))
        blocked = cut_lineage(blocked)   # reliable checkpoint in the shared folder cuts the round lineage
    new_folder = F.when(F.col("parent") == "", F.col("target")).otherwise(F.concat("parent", F.lit("/"), "target"))
    return assigned.select("folder", "parent", F.col("base").alias("segment"), "target", new_folder.alias("new_folder"))


def package_map(plan: DataFrame) -> DataFrame:
    """old package -> new package for every moved folder, with the candidate's path order as ``prio``."""
    return (plan.select(T.normalize_package("folder").alias("old_pkg"), T.normalize_package("new_folder").alias("new_pkg"),
                        F.col("folder").alias("prio"))
                .filter(F.col("old_pkg") != F.col("new_pkg")))


# A11
def move_paths(files: DataFrame, plan: DataFrame) -> DataFrame:
    """Replace the folder part of each file path by its new folder: add ``new_folder`` (null: stays) and ``new_path``.

    The plan is looked up in the row (``lookup.with_map``), so a file's other columns stay where they are."""
    moved = with_map(files, F.array("folder"), plan.select("folder", "new_folder").filter("folder is not null"), "_to", "folder", "new_folder")
    out = moved.withColumn("new_folder", at(F.col("_to"), F.coalesce("folder", F.lit("")))).drop("_to")
    folder = F.coalesce("new_folder", "folder")
    return out.withColumn("new_path", F.concat_ws("/", F.when(folder != "", folder), F.col("file_name")))


# J8
def lookup_or_default(seg: DataFrame, model_segments: DataFrame) -> DataFrame:
    """Model segment per folder when the reply named it (sanitised), else the heuristic segment."""
    # the earliest reply (by its call and position columns) that names the folder wins
    order = [c for c in model_segments.columns if c not in ("folder", "new_segment")] + ["new_segment"]
    m = (model_segments.filter(F.col("new_segment").isNotNull() & (F.trim("new_segment") != "")).groupBy("folder")
         .agg(F.min_by("new_segment", F.struct(*order)).alias("_m")))
    j = seg.join(m, "folder", "left")
    return (j.withColumn("source", F.when(F.col("_m").isNotNull(), F.lit("model")).otherwise(F.lit("heuristic")))
             .withColumn("segment", F.when(F.col("_m").isNotNull(), T.sanitize_segment(F.col("_m")))
                         .otherwise(F.col("segment")))
             .drop("_m"))
