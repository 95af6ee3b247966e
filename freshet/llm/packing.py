"""Packing documents into sequences by non-negative least squares on the histogram of lengths.

A document's token ids, and an end id, are cut into full windows and a rest. The rests' histogram (a number for each length
under the window) goes to the driver: all combinations of up to three lengths that fill a window exactly are
enumerated, non-negative least squares gives how often to repeat each, the counts are rounded down, and what is left over
is packed greedily, largest first, again as combinations with a repeat count. So the plan's size depends on the window,
not on the documents. Each rest then finds its sequence by its rank among the rests of its length.

Ids come from a byte-level BPE vocabulary by its ranks, and from the tokenizer's own file where that fails; both give the
same ids. Special tokens' strings in a text become their ids, as in the tokenizer's default.

Defined results: a null or empty text is the end id alone; a very long text has as many full windows as it needs (its ids are in
one task's memory, four bytes each); equal rows get places of their own; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_of

WINDOW = 1024
END = 0
VOCABULARY = "byte_bpe_50k"


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """text -> ids, by the vocabulary's ranks; the tokenizer's own file is the way for texts on which that fails."""
    import tiktoken

    special = {"<|endoftext|>": 50256}
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow: list = []

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        except BaseException as error:  # the regex engine gives up on some very long runs, with an error that is no Exception
            if type(error).__name__ != "PanicException":
                raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def combinations(window: int) -> np.ndarray:
    """All ways to fill a window with one to three lengths in falling order; 0 stands for none."""
    a = np.arange(1, window + 1)
    pairs = np.array([(x, window - x, 0) for x in range((window + 1) // 2, window)], np.int64).reshape(-1, 3)
    b = [np.stack([np.full(m.size, x), window - x - m, m], 1) for x in a if (m := np.arange(max(1, window - 2 * x), (window - x) // 2 + 1)).size]
    triples = np.concatenate(b) if b else np.zeros((0, 3), np.int64)
    return np.concatenate([pairs, triples])


def least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths near ``counts`` (accelerated projected gradient)."""
    total = max(1.0, counts.sum())
    h = counts / total

    def use(x: np.ndarray) -> np.ndarray:
        s = sum(np.bincount(combos[:, j], x, len(h)) for j in range(3))
        s[0] = 0.0
        return s

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue, for the step
        w = use(v)
        v = sum(np.where(combos[:, j] > 0, w[combos[:, j]], 0.0) for j in range(3))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        r = use(y) - h
        r[0] = 0.0
        z = np.maximum(0.0, y - (r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]) / (1.05 * top))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / s * (z - x), z, s
    return x * total


def packing_plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations as ([(length, times)], repeats) that use up ``counts`` (by length) exactly."""
    left, plan = counts.astype(np.int64).copy(), []
    left[0] = 0
    if left.sum():
        combos = combinations(window)
        combos = combos[(left[combos[:, 0]] > 0) & ((combos[:, 1] == 0) | (left[combos[:, 1]] > 0)) & ((combos[:, 2] == 0) | (left[combos[:, 2]] > 0))]
        if len(combos):
            x = least_squares(combos, left.astype(float))
            for i in np.argsort(-x, kind="stable"):
                want = int(x[i] + 1e-9)
                if want < 1:
                    break
                lengths, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
                n = int(min(want, (left[lengths] // times).min()))
                if n:
                    left[lengths] -= n * times
                    plan.append((list(zip(lengths[::-1].tolist(), times[::-1].tolist(), strict=True)), n))
    while left.any():
        room, members, at = window, [], window
        have = left.copy()
        while room:
            fit = np.flatnonzero(have[: min(room, at) + 1])
            if not len(fit):
                break
            at = int(fit[-1])
            m = int(min(have[at], room // at))
            members.append((at, m))
            room -= at * m
            have[at] = 0
        n = int(min(left[a] // m for a, m in members))
        for a, m in members:
            left[a] -= n * m
        plan.append((members, n))
    return plan


def pieces_of(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """Full windows with a sequence of their own, and rests with their task and rank among the task's rests of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        full, ranks, tail = 0, np.zeros(window, np.int64), np.array([END], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), tail]).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    rows.append((doc, start, n, zlib.crc32(piece.tobytes()), len(ids), part, 2 * ((part << 36) + full) + 1 if n == window else None, None if n == window else int(ranks[n])))
                    if n == window:
                        full += 1
                    else:
                        ranks[n] += 1
            if rows:
                names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "sequence_id", "task_rank")
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows, strict=True), strict=True)})

    return text_of(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence_id long, task_rank long")


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Full windows have odd sequence ids."""
    pieces = durable(pieces_of(docs, window, vocabulary), "pieces")
    rests = pieces.where("sequence_id is null")
    each = rests.groupBy("part", "length").count()
    counts = np.zeros(window + 1, np.int64)
    for row in each.groupBy("length").agg(F.sum("count")).collect():
        counts[row[0]] = row[1]
    # For each length, ranks lo to hi - 1 go `times` at a time to sequences from `first` on, behind `before` tokens.
    steps, taken, first = [], np.zeros(window + 1, np.int64), 0
    for members, repeats in packing_plan(counts, window):
        before = 0
        for length, times in members:
            lo = int(taken[length])
            taken[length] += times * repeats
            steps.append((length, lo, int(taken[length]), times, first, before))
            before += length * times
        first += repeats
    w = Window.partitionBy("length").orderBy("part")
    base = each.select("part", "length", (F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("base"))
    ranked = rests.drop("sequence_id").join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    plan = F.broadcast(docs.sparkSession.createDataFrame(steps or [(0, 0, 0, 1, 0, 0)], "plan_length long, lo long, hi long, times long, first long, before long"))
    inner = F.col("rank") - F.col("lo")
    placed = ranked.join(plan, (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    packed = placed.select(*columns, (2 * (F.col("first") + F.floor(inner / F.col("times")))).alias("sequence_id"), (F.col("before") + inner % F.col("times") * F.col("length")).alias("offset"))
    alone = pieces.where("sequence_id is not null").select(*columns, "sequence_id", F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
