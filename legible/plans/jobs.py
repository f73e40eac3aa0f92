"""End-to-end jobs (L1-L6) composed from the operators; DataFrames flow between stages.

Stage outputs that are reused or that come from a model are materialised in the shared
checkpoint folder (``spark.checkpoint.dir``) so that a lost executor or a task retry never
repeats model calls or re-scans the sources.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators import extract as E
from legible.operators import folders as FO
from legible.operators import infer as I
from legible.operators import rewrite as R
from legible.operators import suggest as S
from legible.operators.heuristics import heuristic_doc
from legible.operators.order import dense_seq
from legible.operators.spans import apply_spans
from legible.operators.util import join_nulls
from legible.operators.pack import MAX_ITEMS, TOKEN_BUDGET, pack_by_budget
from legible.session import cut_lineage


@dataclass
class Options:
    """One typed configuration passed through every stage (Q13).

    Providers are callables ``list[str] -> list[str]``; None means the offline heuristics.  ``provider`` names identifiers
    (one prompt a call), ``doc_provider`` writes one text for each of up to ``doc_batch`` prompts a call, ``folder_provider``
    names up to ``folders_per_call`` folders (one prompt a call)."""
    provider: object | None = None
    doc_provider: object | None = None
    folder_provider: object | None = None
    policy: I.RetryPolicy | None = None     # tries, waits and the timeout of every call
    token_budget: int = TOKEN_BUDGET
    max_items: int = MAX_ITEMS
    doc_batch: int = 12
    folders_per_call: int = FO.FOLDERS_PER_CALL
    concurrency: int = 8
    retries: int = 1                        # rounds over calls that still failed for a passing reason
    replies_path: str | None = None         # replies kept across runs; None: written for this run only
    doc_lang: str = "en"
    doc_style: str = "concise"
    overwrite_docs: bool = False
    flat_names: bool = False
    normalize_packages: bool = False        # every file gets its path's package line, as the reference does
    names_per_folder: int | None = None     # names a folder's heuristic counts (the reference: 40; None: all)
    refactor_packages: bool = False         # L6: package refactor between apply and annotate
    exclude_globs: list = field(default_factory=list)

    def calls(self, what: str) -> dict:
        """Arguments of ``infer.saved_infer`` for one kind of call."""
        return {"concurrency": self.concurrency, "policy": self.policy, "rounds": self.retries,
                "path": None if self.replies_path is None else "%s/%s" % (self.replies_path.rstrip("/"), what)}


def included(files: DataFrame, opts: Options, path_col: str = "rel_path") -> DataFrame:
    """Files that no exclusion glob names (S3)."""
    if not opts.exclude_globs:
        return files
    return files.filter(~F.coalesce(T.excluded_by(path_col, list(opts.exclude_globs)), F.lit(False)))


# L1
def analyze_job(files: DataFrame, opts: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files -> (declarations, units, rejects); declarations are materialised once."""
    decls = cut_lineage(E.java_declarations(included(files, opts)))
    rejects = decls.filter(F.col("unit_kind") == "error").select("file", "error")
    return decls, E.java_units(decls, flat_names=opts.flat_names), rejects


# L2
def suggest_job(units: DataFrame, opts: Options = Options()) -> DataFrame:
    """units -> mapping (long form).  Offline: heuristic names.  With a provider: pack -> prompts ->
    inference (saved) -> parse -> resolve -> first-wins; missing kinds are filled (U4)."""
    keys = cut_lineage(S.allowed_keys(units))
    if opts.provider is None:
        mapping = S.heuristic_names(units)
    else:
        blocks = I.prompt_block(units.withColumn("_grp", F.col("pkg")))
        packed = pack_by_budget(blocks, ["_grp"], ["unit_order"], text_col="block",
                                budget=opts.token_budget, max_items=opts.max_items)
        prompts = I.batch_prompts(packed, ["_grp", "batch_no"])
        replies = I.saved_infer(prompts, opts.provider, ["_grp", "batch_no"], **opts.calls("names"))
        # submission order = (group, batch): a dense rank by range partitioning (no single-partition window, and
        # numbers that leave room for the position however many packages there are)
        calls = dense_seq(prompts.select("_grp", "batch_no").distinct().withColumn("_one", F.lit(0)), ["_one"],
                          ["_grp", "batch_no"], out="batch_id").drop("_one")
        ranked = join_nulls(replies, calls, ["_grp", "batch_no"])
        sugg = I.parse_suggestions(ranked, ["batch_id"])
        mapping = S.suggestions_to_mapping(sugg, None, keys)
    restricted = S.restrict_to_allowed(mapping, keys)
    return S.fallback_fill(restricted, units, keys)


# L3
def apply_job(files: DataFrame, mapping: DataFrame, key: str = "rel_path", decls: DataFrame | None = None) -> DataFrame:
    """A1-A8 in one pass: imports, class names, members in their owner's file and short names are spans on the original
    text (``spans.apply_spans``); adds ``new_text``, ``n_replacements`` (all kinds) and ``hits`` by kind.  The mapping is
    written once: several lookups read it.  With the files' declarations ``new_path`` follows renamed top types (A13)."""
    rules = cut_lineage(S.effective_rules(mapping))
    out = apply_spans(files, rules, path_col=key)
    return out if decls is None else R.rename_files_for_types(out, decls, rules, key)


# L4
def doc_items(decls: DataFrame, opts: Options = Options()) -> DataFrame:
    """The targets (E13) with ``doc`` and ``source`` (model or heuristic): E14 -> I10, and with a doc provider W8 -> I3 ->
    I5/I6 -> J9 -> T12, where a failed call and a missing or blank text fall back item by item (I11)."""
    targets = E.doc_targets(decls, opts.overwrite_docs)
    items = targets.withColumn("snippet", E.doc_snippet(targets))
    ours = heuristic_doc(F.col("snippet"), opts.doc_lang, opts.doc_style)
    if opts.doc_provider is None:
        return items.withColumn("doc", ours).withColumn("source", F.lit("heuristic")).drop("snippet")
    key = ["file", "ordinal"]
    prompts = items.select(*key, I.doc_prompt("snippet", opts.doc_lang, opts.doc_style).alias("prompt"))
    texts = I.infer_items(prompts, opts.doc_provider, key, opts.doc_batch, **opts.calls("docs"))
    texts = texts.withColumn("doc", T.clean_doc_text("doc"))
    return I.provider_fallback(items.drop("snippet"), texts, items.select(*key, ours.alias("doc")), key, "doc")


def annotate_job(files: DataFrame, decls: DataFrame, opts: Options = Options(), key: str = "rel_path") -> DataFrame:
    """``doc_items`` -> tags (T13) -> doc blocks (T14) -> splice (A14): add ``new_text``, ``n_docs`` and ``n_model``."""
    items = doc_items(decls, opts)
    is_member = F.col("unit_kind").isin("method", "ctor")
    tags = F.when(is_member, T.render_doc_tags(F.col("param_names"),
                                               F.when(F.col("unit_kind") == "method", F.col("return_type")),
                                               F.col("throws"), F.lit(opts.doc_lang))).otherwise(F.lit(""))
    blocks = items.select(F.col("file").alias(key),
                          F.coalesce(F.when(F.coalesce("has_doc", F.lit(False)), F.col("doc_start")), F.col("start")).alias("start"),
                          F.col("start").alias("end"), T.doc_block(F.col("doc"), tags).alias("block"),
                          F.coalesce("indent", F.lit("")).alias("indent"), (F.col("source") == "model").alias("model"))
    per_file = blocks.groupBy(key).agg(F.collect_list(F.struct("start", "end", "block", "indent")).alias("_items"),
                                       F.sum(F.col("model").cast("bigint")).alias("n_model"))
    out = R.attach_docs_in_row(files.join(per_file, key, "left"), F.col("_items"), indent=True)
    return out.drop("_items").withColumn("n_model", F.coalesce("n_model", F.lit(0).cast("bigint")))


# L5
def folder_plan(files: DataFrame, opts: Options = Options()) -> DataFrame:
    """Which folders move where (``folder, parent, segment, target, new_folder, source``), from path columns only.

    Candidates (F4) get a name from the folder provider's replies (I4, I5, I8), saved before use, or the heuristic (J8);
    conflicts are ranked (W6)."""
    paths = cut_lineage(files.select("folder", "name"))
    cands = cut_lineage(FO.suspicious_folders(paths))
    seg = FO.heuristic_segment(cands, paths, opts.names_per_folder)
    if opts.folder_provider is None:
        seg = seg.withColumn("source", F.lit("heuristic"))
    else:
        names = FO.class_names_per_folder(paths.join(cands.select("folder"), "folder", "left_semi"))
        prompts = cut_lineage(I.folder_prompts(cands, names, opts.folders_per_call))
        replies = I.saved_infer(prompts, opts.folder_provider, ["call_no"], **opts.calls("folders"))
        seg = FO.lookup_or_default(seg, I.parse_folder_segments(replies.filter("error is null"), ["call_no"]))
    seg = cut_lineage(seg)
    plan = FO.resolve_name_conflicts(seg, FO.existing_folders(paths))
    return plan.join(seg.select("folder", "source"), "folder")


def package_refactor_job(files: DataFrame, normalize_all: bool = False, opts: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """files (folder, name, file_name, text, any other columns) -> (rewritten files with new_path, package map).

    The plan reads paths only; moves, imports and package lines then change in the row by lookups, so texts are neither
    written in between nor shuffled while plan and map measure below the lookup bound.  By default only moved folders get
    a new package line (Q17); ``normalize_all`` (or the option) rewrites every file's to its path-derived package."""
    plan = cut_lineage(folder_plan(files, opts))
    pm = FO.package_map(plan)
    moved = FO.move_paths(R.rewrite_import_prefix(files, pm), plan)
    target = T.normalize_package(F.coalesce("new_folder", "folder"))
    line = R.rewrite_package_line(F.col("new_text"), target)
    return moved.withColumn("new_text", line if normalize_all or opts.normalize_packages else
                            F.when(F.col("new_folder").isNull(), F.col("new_text")).otherwise(line)), pm


# L6
def rename_and_document(files: DataFrame, opts: Options = Options(), key: str = "rel_path") -> dict:
    """analyze -> suggest -> apply -> annotate; every stage's output is checked non-empty."""
    decls, units, rejects = analyze_job(files, opts)
    if len(units.limit(1).collect()) == 0:
        raise RuntimeError("analyze produced no units")
    mapping = cut_lineage(suggest_job(units, opts))
    applied = cut_lineage(apply_job(files, mapping, key))
    renamed = applied.select(key, F.col("new_text").alias("text"))
    decls2, _, _ = analyze_job(renamed, opts)
    documented = annotate_job(renamed, decls2, opts, key)
    return {"declarations": decls, "units": units, "rejects": rejects, "mapping": mapping,
            "applied": applied, "documented": documented}
