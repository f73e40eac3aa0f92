"""Language-model scores by subword-lattice likelihood.

The vocabulary is that of an existing subword tokenizer.  Its pieces' unigram log probabilities are estimated on the
training texts (pieces of every distinct training word as the tokenizer cuts it, smoothed by ``SMOOTH``); the
stored scores of a merge-based file are ranks, not probabilities, and cannot weight a segmentation.  The
probability that the lattice gives a word is the sum over *all* ways to cut it into pieces (single bytes included,
so every word has one), by a forward recursion in log space.  A training word is one more arc over its whole
length: with N training tokens and V distinct ones it has weight c / (N + V), and the pieces share the remaining
V / (N + V) (Witten-Bell).  A text's score is the sum over its words and one end token.

A plain add-``SMOOTH`` word unigram is returned beside it (``base_score``).

Scale: texts are dealt to blocks of bounded size; (1) each block's distinct words and training counts go to their
word (one row a word and block), which gives corpus counts and the blocks that need the word; (2) every distinct
word is scored once; (3) each block gets the entries of its own words only, ahead of its texts in one sorted
stream.  A task holds one block's dictionary.  The piece table is bounded by the vocabulary and is the only thing
collected and broadcast.

Edge cases: null text is the empty text (one end token); null ids are held out or trained by the crc32 of the empty
string; a corpus without training texts leaves the smoothed lattice alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legible.llm.common import partitions, stage, text_batches

#: Text bytes a block holds about (more blocks where the session has more shuffle partitions).
BLOCK_BYTES = 32 << 20
#: Distinct words a counting task holds before it passes them on.
HOLD = 400_000
SMOOTH = 0.1
#: How the tokenizer writes a word's start.
START = "▁"
MISSING = -1e9


def piece_scores(names: list[str], counts: dict[int, int], end_piece: int) -> tuple[dict[str, float], list[float], float]:
    """Natural-log unigram scores: of pieces, of the 256 single bytes, and of the end piece."""
    total = math.log(sum(counts.values()) + SMOOTH * len(names))
    score = [math.log(counts.get(i, 0) + SMOOTH) - total for i in range(len(names))]
    byte = [MISSING] * 256
    pieces = {}
    for i, n in enumerate(names):
        if len(n) == 6 and n.startswith("<0x") and n.endswith(">"):
            byte[int(n[3:5], 16)] = score[i]
        elif not (n.startswith("<") and n.endswith(">")):
            pieces[n] = score[i]
    return pieces, byte, score[end_piece]


def lattice(word: str, pieces: dict[str, float], byte: list[float], longest: int) -> float:
    """Natural log of the probability of a word summed over all segmentations."""
    text = START + word
    n = len(text)
    alpha = [0.0] + [MISSING] * n
    get, exp, log = pieces.get, math.exp, math.log
    for j in range(1, n + 1):
        terms = [alpha[j - 1] + sum(byte[b] for b in text[j - 1].encode())]
        for i in range(max(0, j - longest), j):
            p = get(text[i:j])
            if p is not None:
                terms.append(alpha[i] + p)
        top = max(terms)
        alpha[j] = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top
    return alpha[n]


def _counted(src: DataFrame) -> DataFrame:
    """``word, c`` (training count) ``, blocks`` of every distinct word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], Counter] = {}

        def rows() -> pa.RecordBatch:
            blocks = {b for b, _ in held}
            words, at, n = [], [], []
            for b in blocks:
                train, rest = held.get((b, False), Counter()), held.get((b, True), Counter())
                words += train.keys()
                n += train.values()
                late = [w for w in rest if w not in train]
                words += late
                n += [0] * len(late)
                at += [b] * (len(train) + len(late))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(at, pa.int32()), pa.array(n, pa.int64())],
                                              ["word", "block", "c"])

        for b in batches:
            for block, out, text in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((block, out), Counter()).update((text or b"").lower().split())
            if sum(map(len, held.values())) > HOLD:
                yield rows()
                held.clear()
        yield rows()

    n = partitions(src.sparkSession)
    dealt = src.select("block", "held", "_text").repartition(n, "block")
    # a word is in a block's list once or a few times, so the list is bounded by the number of blocks
    return (dealt.mapInArrow(count, "word binary, block int, c bigint").groupBy("word")
            .agg(F.sum("c").alias("c"), F.collect_set("block").alias("blocks")))


def _pieces(words: DataFrame, model: bytes) -> dict[int, int]:
    """How often each piece occurs in the tokenizer's cut of the distinct training words (bounded by the vocabulary)."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total = np.zeros(tok.get_piece_size(), np.int64)
        for b in batches:
            ids = tok.encode([w.decode() for w in b.column(0).to_pylist()], num_threads=1)
            total += np.bincount(np.fromiter((i for x in ids for i in x), np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

    made = words.filter("c > 0").select("word").mapInArrow(cut, "piece int, n bigint")
    return {r["piece"]: r["n"] for r in made.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def lattice_scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                   folds: int = 10) -> DataFrame:
    """Per input row: ``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    Texts whose crc32 of the id as text is 0 modulo ``folds`` are held out, all others are learned from."""
    spark = docs.sparkSession
    text_batches(spark, 4000)
    with open(model_path, "rb") as f:
        model = f.read()
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("_id"), (F.crc32(key.cast("binary")) % folds == 0).alias("held"),
                      F.col(text_col).cast("binary").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    facts = src.agg(F.sum(F.octet_length("_text")).alias("size"), F.sum((~F.col("held")).cast("long")).alias("train")).first()
    n_blocks = max(partitions(spark), -(-(facts["size"] or 0) // BLOCK_BYTES))
    src = src.withColumn("block", F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).cast("int"))

    words = stage(_counted(src), "lm-words")
    sums = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    train = facts["train"] or 0
    n, v = (sums["n"] or 0) + train, (sums["v"] or 0) + (train > 0)
    tok = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [tok.id_to_piece(i) for i in range(tok.get_piece_size())]
    table = spark.sparkContext.broadcast(piece_scores(names, _pieces(words, model), tok.eos_id()))
    longest = max(map(len, names))

    def token(c: int, inside: float) -> float:
        """log10 probability of a token with training count c and lattice score ``inside``."""
        share = (c + v * math.exp(inside)) / (n + v) if n else math.exp(inside)
        return math.log10(share) if share > 1e-300 else (inside + (math.log(v / (n + v)) if n else 0)) / math.log(10)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte, _ = table.value
        for b in batches:
            made = [token(c, lattice(w.decode(), pieces, byte, longest)) for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], ["word", "c", "blocks", "p"])

    low = math.log10(n + SMOOTH * (v + 1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_base, end_score = math.log10(train + SMOOTH) - low, token(train, table.value[2])
        at, index, counts, scores = None, {}, [], []
        for b in batches:
            block, is_text = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(is_text.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                part = b.slice(s, e - s)
                if s < e and block[s] != at:
                    at, index, counts, scores = block[s], {}, [], []
                if s < e and not is_text[s]:
                    index.update(zip(part.column(4).to_pylist(), range(len(index), len(index) + e - s)))
                    counts.append(part.column(5).to_numpy())
                    scores.append(part.column(6).to_numpy())
                elif s < e:
                    c = np.concatenate([*counts, np.zeros(0, np.int64)])
                    p, base = np.concatenate([*scores, np.zeros(0)]), np.log10(c + SMOOTH) - low
                    counts, scores, out = [c], [p], []
                    for text in part.column(4).to_pylist():
                        ws = (text or b"").lower().split()
                        k = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
                        out.append((len(ws) + 1, int((c[k] > 0).sum()) + (train > 0), float(base[k].sum()) + end_base,
                                    float(p[k].sum()) + end_score))
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(2), part.column(3), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                         pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                        ["_id", "held", "n_tokens", "n_known", "base_score", "score"])

    entries = words.mapInArrow(score, "word binary, c bigint, blocks array<int>, p double").select(
        F.explode("blocks").alias("block"), F.lit(False).alias("is_text"), F.lit(None).cast(kind).alias("_id"),
        F.lit(None).cast("boolean").alias("held"), F.col("word").alias("_text"), "c", "p")
    texts = src.select("block", F.lit(True).alias("is_text"), "_id", "held", "_text",
                       F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("p"))
    scored = entries.union(texts).repartition(partitions(spark), "block").sortWithinPartitions("block", "is_text").mapInArrow(
        add, f"_id {kind}, held boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
