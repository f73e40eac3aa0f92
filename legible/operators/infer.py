"""Prompts, batch inference and reply parsing (I1-I8, I11, J9, T10/T11 use).

A provider is a plain Python callable ``provider(prompts: list[str]) -> list[str]`` (one reply
per prompt).  ``batch_infer`` runs it inside ``mapInPandas``: the number of partitions is the
number of concurrent calls, so a rate limit is a partition count.  A failing call yields a row
with ``error`` set and never stops the job; ``retry_failed`` re-runs only transient failures.
Because a task retry repeats calls, results should be written to a table before they are used
(``save_replies``) and finished batches are never called again (left-anti on the saved ids).
"""

from __future__ import annotations

import json
import random
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.functions import text as T
from legible.operators.util import join_nulls, small_batches
from legible.session import cut_lineage

# ---- fixed values that must equal the reference's behaviour ---------------------------------
NAMES_MAX_TOKENS = 4096       # max_tokens of a rename request
DOCS_MAX_TOKENS = 256         # max_tokens of a doc request
FOLDERS_MAX_TOKENS = 800      # max_tokens of a folder request
TEMPERATURE = 0.2
HEAD_LINES, TAIL_LINES = 50, 50          # prompt trim of rename blocks
DOC_HEAD, DOC_TAIL = 40, 30              # prompt trim of doc snippets
RETRY_TRIES, RETRY_INITIAL_MS, RETRY_FACTOR, RETRY_JITTER_MS, RETRY_CAP_MS = 6, 800, 1.8, 300, 30_000
RATE_LIMIT_FLOOR_MS = 1500               # minimum wait after a 429
# ----------------------------------------------------------------------------------------------

# Our own prompt wording (the model contract, not a reference constant).
RENAME_RULES = (
    "You rename identifiers of obfuscated Java code. Reply with JSON only: an array of objects "
    "{\"kind\": \"class|method|field|var\", \"old\": \"...\", \"new\": \"...\"}. "
    "Use camelCase for methods, fields and variables and PascalCase for classes; keep names that are already clear.")
DOC_RULES = {"en": "Write a one-sentence Javadoc summary for the code below. Reply with the sentence only.",
             "zh": "为下面的代码写一句 Javadoc 摘要，只回复这句话。"}
TRANSIENT = "(?i)(timeout|timed out|429|rate limit|502|503|504|connection reset|temporar)"

REPLY_SCHEMA = ("array<struct<kind:string,type:string,old:string,oldName:string,`from`:string,key:string,name:string,"
                "new:string,newName:string,`to`:string,value:string,rename:string>>")
WRAPPED_SCHEMA = "struct<renames:%s,items:%s>" % (REPLY_SCHEMA, REPLY_SCHEMA)


# I1
def prompt_block(units: DataFrame, head: int = HEAD_LINES, tail: int = TAIL_LINES) -> DataFrame:
    """META header + fenced, head/tail-trimmed code per unit."""
    def nv(c):
        return F.coalesce(F.col(c), F.lit(""))
    params = F.coalesce(F.col("param_types"), F.array().cast("array<string>"))
    strings = F.coalesce(F.col("strings"), F.array().cast("array<string>"))
    block = F.concat(
        F.lit("// META\n"),
        F.lit("packageName: "), nv("pkg"), F.lit("\n"),
        F.lit("className: "), nv("class_name"), F.lit("\n"),
        F.lit("classFqn: "), nv("class_fqn"), F.lit("\n"),
        F.lit("methodName: "), nv("method_name"), F.lit("\n"),
        F.lit("methodSignature: "), nv("qualified_signature"), F.lit("\n"),
        F.when(F.size(params) > 0, F.concat(F.lit("paramTypes: "), F.array_join(params, ","), F.lit("\n")))
         .otherwise(F.lit("")),
        F.when(F.size(strings) > 0, F.concat(F.lit("strings: "), T.string_hint(strings), F.lit("\n")))
         .otherwise(F.lit("")),
        F.lit("\n```java\n"), T.trim_head_tail(T.truncate_text("code"), head, tail), F.lit("\n```\n"))
    return units.withColumn("block", block)


# I2 / I4
def batch_prompts(blocks: DataFrame, batch_keys: list[str], rules: str = RENAME_RULES,
                  block_col: str = "block", pos_col: str = "pos") -> DataFrame:
    """One prompt per batch: rules, then numbered blocks in batch order (a batch is bounded)."""
    g = blocks.groupBy(*batch_keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(block_col).alias("b")))).alias("_xs"))
    body = F.array_join(F.transform("_xs", lambda x: F.concat(F.lit("### ITEM "), (x["p"] + 1).cast("string"),
                                                             F.lit("\n"), x["b"])), "\n")
    return g.select(*batch_keys, F.size("_xs").cast("bigint").alias("n_items"),
                    F.concat(F.lit(rules + "\n\n"), body).alias("prompt"))


# I3
def doc_prompt(snippet, lang, style) -> "F.Column":
    """Per-snippet doc prompt: instruction in the target language, style line, fenced snippet."""
    lang_c = F.lit(lang) if isinstance(lang, str) and lang in DOC_RULES else T._c(lang)
    style_c = F.lit(style) if isinstance(style, str) else T._c(style)
    rules = F.when(lang_c == "zh", F.lit(DOC_RULES["zh"])).otherwise(F.lit(DOC_RULES["en"]))
    return F.concat(rules, F.lit("\nStyle: "), style_c, F.lit("\n\n```java\n"),
                    T.trim_head_tail(T._c(snippet), DOC_HEAD, DOC_TAIL), F.lit("\n```\n"))


FOLDER_RULES = ("Suggest a short, lower-case package segment for each folder below. Reply with JSON only: "
                "{\"<key>\": {\"newSegment\": \"...\"}}.")


# I4
def folder_prompts(cands: DataFrame, names: DataFrame, per_call: int = 100) -> DataFrame:
    """One prompt per ``per_call`` candidate folders (path order): key, package, class names."""
    from legible.operators.order import fixed_slices
    per_folder = names.groupBy("folder").agg(
        F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("_names"))   # <= 40 names each
    c = cands.join(per_folder, "folder", "left").withColumn("_one", F.lit(0))
    c = fixed_slices(c, ["_one"], ["folder"], per_call, out="call_no")
    line = F.concat(F.lit("- key: "), F.col("folder"), F.lit(" | package: "), F.col("pkg"), F.lit(" | classes: "),
                    F.coalesce("_names", F.lit("")))
    g = c.groupBy("call_no").agg(F.array_sort(F.collect_list(F.struct("folder", line.alias("l")))).alias("_xs"))
    return g.select("call_no", F.size("_xs").cast("bigint").alias("n_folders"),
                    F.concat(F.lit(FOLDER_RULES + "\n\n"), F.array_join(F.transform("_xs", lambda x: x["l"]), "\n"))
                    .alias("prompt"))


# T15 over prompts
def with_request(prompts: DataFrame, model: str, max_tokens: int = NAMES_MAX_TOKENS,
                 system: str = "You are a precise code-renaming assistant.") -> DataFrame:
    return prompts.withColumn("request", T.json_request(F.lit(system), F.col("prompt"), model, max_tokens, TEMPERATURE))


@dataclass
class RetryPolicy:
    tries: int = RETRY_TRIES
    initial_ms: int = RETRY_INITIAL_MS
    factor: float = RETRY_FACTOR
    jitter_ms: int = RETRY_JITTER_MS
    cap_ms: int = RETRY_CAP_MS
    sleep: bool = True
    timeout_s: float | None = None           # of one call; None leaves it to the provider's transport

    def delays(self):
        d = self.initial_ms
        for _ in range(self.tries - 1):
            yield min(self.cap_ms, d + random.randint(0, self.jitter_ms)) / 1000.0
            d = d * self.factor


def _timed(call, timeout_s: float | None):
    """``call()``; after ``timeout_s`` seconds a timeout error (the worker thread is left behind)."""
    if timeout_s is None:
        return call()
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout_s)
    except FutureTimeout:
        raise TimeoutError("timeout after %s s" % timeout_s) from None
    finally:
        pool.shutdown(wait=False)


def _call_with_retry(provider, prompt: str, policy: RetryPolicy):
    return _retried(lambda: provider([prompt])[0], policy)


def _retried(call, policy: RetryPolicy):
    """(result, error, attempts) of a call without arguments."""
    attempts, last = 0, None
    delays = list(policy.delays()) + [None]
    for delay in delays:
        attempts += 1
        try:
            return _timed(call, policy.timeout_s), None, attempts
        except Exception as e:  # noqa: BLE001 - a provider error becomes data
            last = T_squash(str(e)) or type(e).__name__
            if not re.search(TRANSIENT, last) or delay is None:
                break
            retry_after = getattr(e, "retry_after", None)       # seconds, when the transport knows it
            if retry_after is not None:
                delay = float(retry_after)
            elif "429" in last:
                delay = max(delay, RATE_LIMIT_FLOOR_MS / 1000.0)
            if policy.sleep:
                time.sleep(delay)
    return None, last, attempts


def T_squash(s: str, n: int = 300) -> str:
    s = re.sub(r"[ \t\n\x0b\f\r]+", " ", s or "")
    return s[:n] + "..." if len(s) > n else s


# I5
def batch_infer(prompts: DataFrame, provider: Callable[[list[str]], list[str]], key_cols: list[str],
                prompt_col: str = "prompt", concurrency: int | None = None,
                policy: RetryPolicy | None = None) -> DataFrame:
    """Run ``provider`` over every prompt; output ``key_cols + reply, error, attempts``.

    A string ``prompt_col`` is one prompt and gets one reply; an array of strings is one call for several items and gets
    the array of what the provider returned (``reply array<string>``, of any length).  ``concurrency`` partitions =
    concurrent calls.  Inputs are hash-partitioned on the key so a retried task sees the same prompts."""
    pol = policy or RetryPolicy()
    many = prompts.schema[prompt_col].dataType.simpleString() != "string"
    sch = prompts.select(*key_cols).schema
    out_schema = ", ".join("`%s` %s" % (f.name, f.dataType.simpleString()) for f in sch.fields) + \
        ", reply %s, error string, attempts int" % ("array<string>" if many else "string")
    small_batches(prompts.sparkSession)
    src = prompts.select(*key_cols, prompt_col)
    if concurrency:
        src = src.repartition(concurrency, *key_cols)

    def ask(p):
        if many:
            out = provider([str(x) for x in p])
            return None if out is None else [None if x is None else str(x) for x in out]
        return provider([p])[0]

    def run(batches):
        for pdf in batches:
            replies, errors, attempts = [], [], []
            for p in pdf[prompt_col].tolist():
                r, e, a = _retried(lambda p=p: ask(p), pol)
                replies.append(r)
                errors.append(e)
                attempts.append(a)
            out = pdf[key_cols].copy()
            out["reply"], out["error"], out["attempts"] = pd.Series(replies, dtype=object, index=out.index), errors, pd.array(attempts, dtype="int32")
            yield out

    return src.mapInPandas(run, out_schema)


# I6
def retry_failed(results: DataFrame, prompts: DataFrame, provider, key_cols: list[str], rounds: int = 1,
                 prompt_col: str = "prompt", policy: RetryPolicy | None = None, concurrency: int | None = None) -> DataFrame:
    """Re-run rows whose error looks transient, ``rounds`` times; finished rows are kept as they are.  Null keys are
    keys like any other.

    Every round's replies are written before they are read, so no later action calls the model again."""
    cur = results
    for _ in range(rounds):
        failed = cur.filter(F.col("error").isNotNull() & F.col("error").rlike(TRANSIENT)).select(*key_cols)
        redo = join_nulls(prompts, failed, key_cols, "left_semi")
        again = cut_lineage(batch_infer(redo, provider, key_cols, prompt_col, concurrency, policy))
        cur = cut_lineage(join_nulls(cur, failed, key_cols, "left_anti").unionByName(again))
    return cur


def saved_infer(prompts: DataFrame, provider, key_cols: list[str], prompt_col: str = "prompt", concurrency: int | None = None,
                policy: RetryPolicy | None = None, rounds: int = 1, path: str | None = None) -> DataFrame:
    """I5 and I6 with replies written before use.  With ``path`` they are kept there across runs: a prompt whose digest has
    a reply without error in it is not asked again."""
    if path is None:
        first = cut_lineage(batch_infer(prompts, provider, key_cols, prompt_col, concurrency, policy))
        return retry_failed(first, prompts, provider, key_cols, rounds, prompt_col, policy, concurrency) if rounds else first
    spark = prompts.sparkSession
    many = prompts.schema[prompt_col].dataType.simpleString() != "string"
    digest = F.sha2(F.to_json(F.struct(prompt_col)), 256)
    keyed = cut_lineage(prompts.withColumn("_digest", digest))
    run_id = uuid.uuid4().hex
    schema = "_digest string, reply %s, error string, attempts int, run string" % ("array<string>" if many else "string")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def saved():
        return spark.read.schema(schema).parquet(path) if fs.exists(fs_path) else spark.createDataFrame([], schema)

    once = keyed.dropDuplicates(["_digest"])
    for _ in range(rounds + 1):
        done = saved().filter("error is null").select("_digest")
        # an error that no retry can mend is not asked again in this run, a transient one is
        given_up = saved().filter((F.col("run") == run_id) & F.col("error").isNotNull() & ~F.col("error").rlike(TRANSIENT)).select("_digest")
        todo = once.join(done.unionByName(given_up).distinct(), "_digest", "left_anti")
        asked = batch_infer(todo, provider, ["_digest"], prompt_col, concurrency, policy)
        asked.withColumn("run", F.lit(run_id)).write.mode("append").parquet(path)
    best = saved().groupBy("_digest").agg(F.min_by(F.struct("reply", "error", "attempts"), F.col("error").isNotNull()).alias("r"))
    return keyed.select(*key_cols, "_digest").join(best, "_digest", "left").select(*key_cols, "r.reply", "r.error", "r.attempts")


def save_replies(results: DataFrame, path: str) -> DataFrame:
    """Persist inference output so later stages (and task retries) never call the model again."""
    results.write.mode("append").parquet(path)
    return results.sparkSession.read.parquet(path)


def pending_prompts(prompts: DataFrame, saved: DataFrame, key_cols: list[str]) -> DataFrame:
    """Prompts without a saved successful reply."""
    done = saved.filter(F.col("error").isNull()).select(*key_cols)
    return join_nulls(prompts, done, key_cols, "left_anti")


# I7
def parse_suggestions(replies: DataFrame, key_cols: list[str], reply_col: str = "reply") -> DataFrame:
    """Reply -> one row per suggestion ``key_cols, pos, kind, old, new``.

    Accepts a bare array, ``{"renames": [...]}`` or ``{"items": [...]}``, fenced or after prose, with
    the alias field names; items lacking kind, old or new are dropped."""
    # each step is its own projection so the payload and the parsed JSON are computed once
    p = replies.select(*key_cols, T.extract_json_payload(T.extract_chat_content(F.col(reply_col))).alias("_p"))
    p = p.select(*key_cols, "_p", F.when(~F.startswith("_p", F.lit("[")), F.from_json("_p", WRAPPED_SCHEMA)).alias("_w"))
    arr = F.when(F.startswith("_p", F.lit("[")), F.from_json("_p", REPLY_SCHEMA)).otherwise(
        F.coalesce(F.col("_w.renames"), F.col("_w.items")))
    x = p.select(*key_cols, F.posexplode(arr).alias("pos", "it"))
    kind = F.coalesce(F.col("it.kind"), F.col("it.type"))
    old = F.coalesce(F.col("it.old"), F.col("it.oldName"), F.col("it.from"), F.col("it.key"), F.col("it.name"))
    new = F.coalesce(F.col("it.new"), F.col("it.newName"), F.col("it.to"), F.col("it.value"), F.col("it.rename"))
    return (x.select(*key_cols, F.col("pos").cast("bigint").alias("pos"), kind.alias("kind"), old.alias("old"),
                     new.alias("new"))
             .filter(F.col("kind").isNotNull() & F.col("old").isNotNull() & F.col("new").isNotNull()))


# I8
def parse_folder_segments(replies: DataFrame, key_cols: list[str], reply_col: str = "reply") -> DataFrame:
    """Reply object ``{"<folder>": {"newSegment": "..."}}`` -> rows ``folder, new_segment``."""
    payload = T.extract_json_payload(T.extract_chat_content(F.col(reply_col)))
    m = F.from_json(payload, "map<string,struct<newSegment:string>>")
    return replies.select(*key_cols, F.explode(m).alias("folder", "v")).select(
        *key_cols, "folder", F.col("v.newSegment").alias("new_segment"))


# J9
def align_by_position(inputs: DataFrame, outputs: DataFrame, batch_keys: list[str], pos_col: str = "pos",
                      out_col: str = "doc") -> DataFrame:
    """Attach outputs to inputs by (batch, position); missing outputs become '' and extra ones drop."""
    o = outputs.select(*batch_keys, F.col(pos_col), F.col(out_col).alias("_o"))
    return join_nulls(inputs, o, [*batch_keys, pos_col], "left").withColumn(out_col, F.coalesce("_o", F.lit(""))).drop("_o")


# W8 -> I5 -> J9: items in slices, one call a slice, replies back by position
def infer_items(items: DataFrame, provider, order_cols: list[str], size: int, prompt_col: str = "prompt", out_col: str = "doc",
                concurrency: int | None = None, policy: RetryPolicy | None = None, rounds: int = 1, path: str | None = None) -> DataFrame:
    """One text per item from calls of ``size`` items in the order of ``order_cols``: ``order_cols``, ``out_col``.

    A call that fails or returns too few texts leaves '' for what is missing; texts beyond the slice are dropped."""
    from legible.operators.order import dense_seq
    seq = cut_lineage(dense_seq(items.select(*order_cols, prompt_col).withColumn("_one", F.lit(0)), ["_one"], order_cols, out="_seq")
                      .withColumn("call_no", F.floor(F.col("_seq") / F.lit(size)).cast("bigint"))
                      .withColumn("pos", (F.col("_seq") % size).cast("bigint")).drop("_one", "_seq"))
    calls = seq.groupBy("call_no").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(prompt_col).alias("p")))).alias("_xs"))
    calls = calls.select("call_no", F.transform("_xs", lambda x: x["p"]).alias("prompts"))
    replies = saved_infer(calls, provider, ["call_no"], "prompts", concurrency, policy, rounds, path)
    given = replies.select("call_no", F.posexplode("reply").alias("pos", out_col)).withColumn("pos", F.col("pos").cast("bigint"))
    return align_by_position(seq.drop(prompt_col), given, ["call_no"], "pos", out_col).select(*order_cols, out_col)


# I11
def provider_fallback(base: DataFrame, model_out: DataFrame, heuristic_out: DataFrame, keys: list[str],
                      value_col: str) -> DataFrame:
    """Model value where present and non-blank, else the heuristic's; ``source`` tells which."""
    m = model_out.select(*keys, F.col(value_col).alias("_m"))
    h = heuristic_out.select(*keys, F.col(value_col).alias("_h"))
    j = join_nulls(join_nulls(base, m, keys, "left"), h, keys, "left")
    use_m = F.col("_m").isNotNull() & (F.trim("_m") != "")
    return (j.withColumn(value_col, F.when(use_m, F.col("_m")).otherwise(F.col("_h")))
             .withColumn("source", F.when(use_m, F.lit("model")).otherwise(F.lit("heuristic")))
             .drop("_m", "_h"))


class EchoRenameProvider:
    """Deterministic offline provider: proposes ``handle<Method>`` for every META block's method
    and answers in rotating reply shapes (bare array, wrapped, fenced) to exercise the parser."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            names = re.findall(r"^methodName: (\S+)$", p, flags=re.M)
            items = [{"kind": "method", "old": n, "new": "handle" + n[:1].upper() + n[1:]} for n in names]
            shape = len(p) % 3
            if shape == 0:
                out.append(json.dumps(items))
            elif shape == 1:
                out.append(json.dumps({"renames": items}))
            else:
                out.append("Here you go:\n```json\n" + json.dumps(items) + "\n```")
        return out


class FlakyProvider:
    """Test helper: fails with a transient error for prompts whose hash hits ``fail_mod``."""

    def __init__(self, inner, fail_mod: int = 3, message: str = "503 Service Unavailable"):
        self.inner, self.fail_mod, self.message = inner, fail_mod, message

    def __call__(self, prompts):
        for p in prompts:
            if sum(map(ord, p)) % self.fail_mod == 0:
                raise RuntimeError(self.message)
        return self.inner(prompts)
