"""Suffix-array dedup: removal of every byte in a string of SPAN bytes that also starts anywhere else.

1. Sparse suffixes. Each window of SPAN bytes picks one of its suffixes, the start of its K-gram of least hash. Equal windows
   pick the same place, so a window can only repeat if the K bytes there, the head of that suffix, repeat.
2. Distributed merge sort of the picked suffixes' heads. Tasks sort their own into runs, merge copies, front-code them
   (length shared with the one before, then the rest) and deal them by range; a range's runs meet in a loser tree that
   compares two heads only where their shared lengths with the last winner are equal, and only past those. Heads
   that occur once go.
3. Consecutive windows with one suffix are a stretch. Equal stretches (two 64-bit hashes, of head and bytes) repeat whole and
   are one from here on. Different stretches with one head meet, and only their texts are sent: the suffixes at all their
   windows that might repeat are sorted by their bytes, doubling the known common prefix, up to SPAN bytes; equal ones repeat.
4. A document gets its repeated stretches and windows back, and its bytes under them go.

So copies cost one entry a task, and what is sorted, sent or compared is a small share of all suffixes.

Defined results: a null or empty text has no bytes, and nothing to remove; a very long text is looked at in pieces, and counts
whole; copies of a text of SPAN bytes or more lose all
their bytes; equal rows lose the same; matches never cross rows; an empty table gives an empty result; extra columns
are not read by the query and kept by ``without_repeats``. Where a cut splits a character, that character goes, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, _powers, durable, filter_bits, free_name, let_through, mix64, signed, text_blocks

SPAN, K = 200, 32
#: Bytes looked at in one go; a longer text is looked at in overlapping pieces.
PIECE = 1 << 18
#: Groups of more different stretches with one head are compared by a shuffle of their windows instead of in one task.
HOT = 50_000
#: Heads that a task sorts at once, in about 250 bytes each with the copies that sorting takes.
RUN_HEADS = 300_000
#: Ranges of the order, of about so many heads each; a task merges RANGES_A_TASK of them, one after the other.
RANGE_HEADS, MOST_RANGES, RANGES_A_TASK = 50_000, 100_000, 8
_PW = _powers(_BASE, PIECE + 1)
_IPW = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), PIECE + 1)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _PW[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * _IPW[start])


def head_hash(heads: np.ndarray) -> np.ndarray:
    """Hashes of K-byte rows, the same as of those bytes within a text."""
    return mix64((_BYTE[heads] * _PW[:K]).sum(1, dtype=np.uint64))


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, offset of the piece in its row, bounds): texts in pieces that hold each of their windows once. The bytes
    hold one or more pieces; piece i is bounds[i]:bounds[i + 1]."""
    for block in text_blocks(column, PIECE):
        if len(block.data) <= PIECE:
            yield block.data, block.first + np.arange(block.rows), np.zeros(block.rows, np.int64), block.offsets
        else:
            for at in range(0, len(block.data) - SPAN + 1, PIECE - SPAN + 1):
                part = block.data[at : at + PIECE]
                yield part, np.array([block.first]), np.array([at]), np.array([0, len(part)])


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first window, last window, place of the suffix, prefix sums) of the stretches in some bytes."""
    n = len(data)
    sums = _prefix_sums(data)
    if n < SPAN:
        e = np.zeros(0, np.int64)
        return e, e, e, e, sums
    at = np.arange(n - K + 1)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (_hash(sums, at, at + K) >> bits << bits) | at.astype(np.uint64)
    width, have = SPAN - K + 1, 1
    while have * 2 <= width:
        key, have = np.minimum(key[:-have], key[have:]), have * 2
    key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    piece = np.searchsorted(bounds, np.arange(len(place)), "right") - 1
    good = np.arange(len(place)) + SPAN <= bounds[piece + 1]
    first = good.copy()
    first[1:] &= ~good[:-1] | (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    last = good.copy()
    last[:-1] &= ~good[1:] | (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return piece[a], a, b, place[a], sums


def _columns(heads: np.ndarray) -> list[np.ndarray]:
    return [c.astype(np.uint64) for c in np.ascontiguousarray(heads).view(">u8").T]


def sorted_heads(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different heads in order, whether each occurs twice or more, and the length each shares with the one before."""
    heads = heads[np.lexsort(_columns(heads)[::-1])]
    differ = heads[1:] != heads[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), K)
    new = np.r_[True, shared < K][: len(heads)]
    first = np.flatnonzero(new)
    twice = np.diff(np.r_[first, len(heads)]) > 1
    return heads[first], twice, np.r_[0, shared][: len(heads)][first]


def front_coded(heads: np.ndarray, twice: np.ndarray, shared: np.ndarray) -> bytes:
    """A run: its length, a byte of shared length for each head (with 128 if it occurs twice), and the rests."""
    shared = shared.copy()
    shared[:1] = 0
    rests = heads[np.arange(K)[None, :] >= shared[:, None]].tobytes()
    return len(heads).to_bytes(4, "little") + (shared + 128 * twice).astype(np.uint8).tobytes() + rests


def decoded(run: bytes) -> Iterator[tuple[int, int, bool]]:
    """(head as a number, length shared with the one before, occurs twice) of a front-coded run."""
    n = int.from_bytes(run[:4], "little")
    at, before = 4 + n, b""
    for i in range(4, 4 + n):
        shared = run[i] & 127
        end = at + K - shared
        before = before[:shared] + run[at:end]
        at = end
        yield int.from_bytes(before, "big"), shared, run[i] > 127


class LoserTree:
    """Merges sorted runs. Each waiting head has its shared length with the last winner; of two, the one that shares more is
    the smaller, and only equal lengths make a comparison, which tells the loser's new length."""

    def __init__(self, runs: list[Iterator[tuple[int, int, bool]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.head: list[int | None] = [None] * self.size
        self.shared, self.twice = [0] * self.size, [False] * self.size
        for i in range(len(runs)):
            self._next(i)
        self.tree = [0] * self.size
        self.winner = self._build(1) if self.size > 1 else 0

    def _next(self, i: int) -> None:
        x = next(self.runs[i], None)
        if x is None:
            self.head[i] = None
        else:
            self.head[i], self.shared[i], self.twice[i] = x

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        if x == y:
            self.shared[b] = K
            return a, b
        same = (8 * K - (x ^ y).bit_length()) >> 3
        if x < y:
            self.shared[b] = same
            return a, b
        self.shared[a] = same
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.tree[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, int, bool]]:
        """(head, length shared with the one before, occurs twice in its run), in order."""
        head, shared, twice, tree, size = self.head, self.shared, self.twice, self.tree, self.size
        while True:
            w = self.winner
            if head[w] is None:
                return
            yield head[w], shared[w], twice[w]
            self._next(w)
            node = (w + size) >> 1
            while node:
                w, tree[node] = self._play(w, tree[node])
                node >>= 1
            self.winner = w


def _heads_of(column: pa.Array) -> Iterator[np.ndarray]:
    for data, _, _, bounds in pieces(column):
        piece, _, _, place, _ = stretches(data, bounds)
        if len(place):
            place = np.unique(place)
            yield np.lib.stride_tricks.sliding_window_view(data, K)[place]


def splitters(texts: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Heads that cut the order into about equal ranges, from a sample of the ``total`` rows; they only balance the work."""
    rows = max(1000, 2 * ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for heads in _heads_of(batch.column(0)):
                    yield pa.RecordBatch.from_pydict({"head": pa.array([h.tobytes() for h in heads[:: max(1, len(heads) // 500)]], pa.binary())})

    found = texts.select("text").sample(min(1.0, rows / max(1, total)), seed=11).mapInArrow(run, "head binary").limit(max(100_000, 20 * ranges)).collect()
    heads = np.array([np.frombuffer(r[0], np.uint8) for r in found], np.uint8).reshape(-1, K)
    ranges = min(ranges, len(heads))
    if ranges < 2:
        return np.zeros((0, K), np.uint8)
    heads = heads[np.lexsort(_columns(heads)[::-1])]
    return heads[np.arange(1, ranges) * len(heads) // ranges]


def repeated_heads(texts: DataFrame) -> DataFrame:
    """(head long): hashes of the heads that occur twice or more, by the merge sort. Ranges and tasks follow the size of the texts."""
    total, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).collect()[0]
    least = max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = min(MOST_RANGES, max(least, (size or 0) // (RANGE_HEADS * (SPAN - K) // 2)))
    tasks = max(least, ranges // RANGES_A_TASK)
    cuts = [h.tobytes() for h in splitters(texts, total, ranges)]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            heads, twice, shared = sorted_heads(np.concatenate(held))
            key = np.ascontiguousarray(heads).view(f"S{K}").ravel()
            at = [0, *np.searchsorted(key, np.array(cuts, f"S{K}")).tolist(), len(heads)] if cuts else [0, len(heads)]
            parts = [(r, front_coded(heads[a:b], twice[a:b], shared[a:b])) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_pydict({"range": pa.array([r for r, _ in parts], pa.int32()), "run": pa.array([x for _, x in parts], pa.binary())})

        with np.errstate(over="ignore"):
            for batch in batches:
                for heads in _heads_of(batch.column(0)):
                    held.append(heads)
                    count += len(heads)
                    if count > RUN_HEADS:
                        yield flush()
                        held, count = [], 0
            if held:
                yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeats(runs: list[bytes]) -> pa.RecordBatch:
            found, before, told = [], None, None
            for head, shared, twice in LoserTree([decoded(r) for r in runs]):
                if (twice or (shared == K and head == before)) and head != told:
                    found.append(head.to_bytes(K, "big"))
                    told = head
                before = head
            heads = np.frombuffer(b"".join(found), np.uint8).reshape(-1, K)
            return pa.RecordBatch.from_pydict({"head": signed(head_hash(heads)) if len(heads) else np.zeros(0, np.int64)})

        held, current = [], None
        with np.errstate(over="ignore"):
            for batch in batches:
                for r, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if r != current and held:
                        yield repeats(held)
                        held = []
                    current = r
                    held.append(run)
            if held:
                yield repeats(held)

    runs = texts.select("text").mapInArrow(sort, "range int, run binary")
    task = F.floor(F.col("range") * F.lit(tasks) / F.lit(len(cuts) + 1)).cast("int")
    return runs.repartitionById(tasks, task).sortWithinPartitions("range").mapInArrow(merge, "head long")


def _stretches_with(batches: Iterator[pa.RecordBatch], wanted: tuple[np.ndarray, int] | None) -> Iterator[tuple]:
    """Stretches whose head's bit is set (all if ``wanted`` is None): (bytes, row, start in the row, first and last window, head, same); ``same`` is a hash of a
    stretch's bytes and of its suffix's place in them."""
    for batch in batches:
        for data, row, offset, bounds in pieces(batch.column(0)):
            piece, a, b, place, sums = stretches(data, bounds)
            head = _hash(sums, place, place + K)
            on = np.arange(len(head)) if wanted is None else let_through(head, wanted)
            if len(on):
                piece, a, b, place, head = piece[on], a[on], b[on], place[on], head[on]
                same = mix64(_hash(sums, a, b + SPAN) + (place - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b - a).astype(np.uint64))
                yield batch, data, row[piece], a - bounds[piece] + offset[piece], a, b, head, same


def candidate_stretches(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, same, row_key, doc, start, windows): stretches whose head repeats, and where they are."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_bits(heads.withColumnRenamed("head", "id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, _, row, start, a, b, head, same in _stretches_with(batches, shared.value):
                yield pa.RecordBatch.from_pydict({"head": signed(head), "same": signed(same), "row_key": batch.column(1).to_numpy()[row], "doc": batch.column(2).to_numpy()[row], "start": start, "windows": (b - a + 1).astype(np.int32)})

    return texts.select("text", "row_key", "doc").mapInArrow(run, "head long, same long, row_key long, doc long, start long, windows int")


def contents(texts: DataFrame, carriers: DataFrame) -> DataFrame:
    """(head, same, content): the bytes of each kind of stretch in ``carriers`` (same, row_key), from the row that carries it. Which stretches
    to send is a bit map over same XOR row_key; the few others that it lets through are copies of kinds, or alone."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_bits(carriers.select(F.col("same").bitwiseXOR(F.col("row_key")).alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, data, row, _, a, b, head, same in _stretches_with(batches, None):
                on = let_through(same ^ batch.column(1).to_numpy().view(np.uint64)[row], shared.value)
                if len(on):
                    yield pa.RecordBatch.from_pydict({"head": signed(head[on]), "same": signed(same[on]), "content": pa.array([data[a[i] : b[i] + SPAN].tobytes() for i in on], pa.binary())})

    return texts.select("text", "row_key").mapInArrow(run, "head long, same long, content binary")


def _window_hashes(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of some stretches, and each one's stretch."""
    size = np.array([len(c) for c in contents])
    hashes, which, i = [], [], 0
    while i < len(contents):
        j = i + max(1, int(np.searchsorted(np.cumsum(size[i:]), PIECE, "right")))
        data = np.frombuffer(b"".join(contents[i:j]), np.uint8)
        sums, ends = _prefix_sums(data), np.cumsum(size[i:j])
        at = np.concatenate([np.arange(e - n, e - SPAN + 1) for e, n in zip(ends, size[i:j], strict=True)])
        hashes.append(_hash(sums, at, at + SPAN))
        which.append(np.repeat(np.arange(i, j), size[i:j] - SPAN + 1))
        i = j
    return np.concatenate(hashes), np.concatenate(which)


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Bytes [from, to) under the windows that are hit."""
    edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
    return [(int(a), int(b) + SPAN - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def equal_windows(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of some stretches: whether the window's bytes occur at another place, and each one's stretch.

    Hashes leave out windows that can't repeat. The others' suffixes are sorted: ranks of suffixes by their first n bytes give
    those by 2n, so that no known prefix is looked at again, up to SPAN; windows of equal rank have equal bytes."""
    hashes, which = _window_hashes(contents)
    _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    if not hit.any():
        return hit, which
    some = np.unique(which[hit])  # stretches with windows that may repeat, one after the other
    size = np.array([len(contents[i]) for i in some])
    data = np.frombuffer(b"".join(contents[i] for i in some), np.uint8)
    first = np.searchsorted(which, some)
    at = np.flatnonzero(hit)
    of = np.searchsorted(some, which[at])
    place = at - first[of] + (np.cumsum(size) - size)[of]
    rank, known = np.zeros(len(data) - 7, np.uint64), 8
    for k in range(8):
        rank = rank << np.uint64(8) | data[k : len(data) - 7 + k]
    while known < SPAN:
        rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
        step = min(known, SPAN - known)
        rank, known = rank[:-step] * np.uint64(len(rank)) + rank[step:], known + step
    _, back, count = np.unique(rank[place], return_inverse=True, return_counts=True)
    hit[at] = count[back] > 1
    return hit, which


def repeats_in_groups(kinds: DataFrame) -> DataFrame:
    """(head, same, lo, hi): bytes of a stretch that are in another one with its head, from (head, same, content). In a partition the
    heads come in order; a group is compared as a whole, in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> pa.RecordBatch:
            head, same = table["head"].to_numpy(), table["same"].to_numpy()
            order = np.lexsort((same, head))
            new = np.r_[True, (head[order][1:] != head[order][:-1]) | (same[order][1:] != same[order][:-1])]
            at = order[new]  # each kind of stretch once
            hit, which = equal_windows(table["content"].take(pa.array(at)).to_pylist())
            first = np.searchsorted(which, np.arange(len(at) + 1))
            out = [(i, lo, hi) for i in range(len(at)) for lo, hi in _spans(hit[first[i] : first[i + 1]])]
            i, lo, hi = np.array(out, np.int64).reshape(-1, 3).T
            return pa.RecordBatch.from_pydict({"head": head[at[i]], "same": same[at[i]], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

        with np.errstate(over="ignore"):
            for batch in batches:
                for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                    held.append(part)
                    table = pa.Table.from_batches(held)
                    head = table["head"].to_numpy()
                    cut = int(np.searchsorted(head, head[-1]))  # the last group may go on
                    if cut:
                        yield compare(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
            if held:
                yield compare(pa.Table.from_batches(held))

    spread = kinds.repartition("head").sortWithinPartitions("head")
    return spread.select("head", "same", "content").mapInArrow(run, "head long, same long, lo int, hi int")


def repeats_by_shuffle(kinds: DataFrame, parts: int = 16) -> DataFrame:
    """The same for large groups: windows meet by their head and hash. What is often is spread over ``parts`` tasks."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    hashes, which = _window_hashes(part.column(2).to_pylist())
                    head, same = part.column(0).to_numpy()[which], part.column(1).to_numpy()[which]
                    at = np.arange(len(which)) - np.searchsorted(which, which)
                    yield pa.RecordBatch.from_pydict({"head": head, "window": signed(hashes), "same": same, "lo": at.astype(np.int32)})

    each = kinds.dropDuplicates(["head", "same"]).select("head", "same", "content")
    windows = durable(each.mapInArrow(explode, "head long, window long, same long, lo int"), "windows")
    often = windows.groupBy("head", "window").count().where("count > 1").select("head", "window", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    spread = windows.withColumn("part", F.pmod(F.xxhash64("same"), F.lit(parts)).cast("int"))
    return spread.join(often, ["head", "window", "part"], "left_semi").select("head", "same", "lo", (F.col("lo") + SPAN).alias("hi"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(row_key, doc, spans): for each text of ``texts`` (text, row_key, doc) with repeats, [from, to) byte ranges that repeat (they may
    overlap). Rows are told apart by row_key and doc together."""
    heads = durable(repeated_heads(texts), "heads")
    found = durable(candidate_stretches(texts, heads), "stretches")
    kind, row = ["head", "same"], ["row_key", "doc"]
    kinds = durable(found.groupBy(*kind).agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.min("row_key").alias("row_key")), "kinds")
    groups = durable(kinds.groupBy("head").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
    whole = kinds.where("n > 1").select(*kind, F.lit(0).alias("lo"), (F.col("windows") + SPAN - 1).alias("hi"))
    mixed = contents(texts, kinds.join(groups, "head", "left_semi"))
    hot = groups.where(F.col("kinds") > HOT).select("head")
    if hot.limit(1).count():
        mixed = durable(mixed, "mixed")
        parts = repeats_in_groups(mixed.join(hot, "head", "left_anti")).unionByName(repeats_by_shuffle(mixed.join(hot, "head", "left_semi")))
    else:
        parts = repeats_in_groups(mixed)
    single = durable(parts, "parts").join(kinds.where("n = 1").select(*kind), kind, "left_semi")
    spans = whole.unionByName(single)
    placed = found.select(*kind, *row, "start").join(spans, kind).select(*row, F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("span"))
    return placed.groupBy(*row).agg(F.collect_set("span").alias("spans"))


def _kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of removed runs."""
    if not spans:
        return raw, 0
    out, runs, end = [], 0, -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if lo > end:
            out.append(raw[max(end, 0) : lo])
            runs, end = runs + 1, hi
        end = max(end, hi)
    out.append(raw[end:])
    return b"".join(out), runs


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans, and its name."""
    text, doc_id = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    key, doc, spans = (free_name(docs, n) for n in ("row_key", "row_doc", "row_spans"))
    keyed = docs.withColumns({key: F.xxhash64(doc_id, text), doc: doc_id})
    found = repeated_spans(keyed.select(text.alias("text"), F.col(key).alias("row_key"), F.col(doc).alias("doc")))
    return keyed.join(found.withColumnsRenamed({"row_key": key, "doc": doc, "spans": spans}), [key, doc], "left"), spans


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, runs = _kept(raw, spans.as_py())
                out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())})

    joined, found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return joined.select("doc_id", "text", found).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes out of their texts and n_chars set anew, in its own type; other columns stay. Rows whose text
    goes whole go."""
    names = docs.columns
    joined, found = _with_spans(docs)
    joined = joined.select(*[F.col(f"`{c}`") for c in names], found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], np.ones(batch.num_rows, bool)
            for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column(found), strict=True)):
                if text.is_valid and spans.is_valid:
                    kept, _ = _kept(text.as_buffer().to_pybytes(), spans.as_py())
                    stay[i] = bool(kept.strip())
                    texts.append(kept.decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_pydict(cols).filter(pa.array(stay))

    return joined.mapInArrow(run, docs.schema)
