"""Similarity join on n-gram Jaccard with set-relation skipping.

A document is the set of its distinct five-word shingles (64-bit hashes). Two sets link if 100 * common >= 80 * union.

* Index: shingles are ordered by falling rarity (exact counts over all documents). A set is indexed under its first
  shingles only, as many as a linked partner must share. A list is sorted by set size and position; a block of one size
  is entered up to the last position that leaves enough common shingles, and skipped if there is none.
* Groups: equal sets are one set. Sets in a long list are checked against leaders and near neighbours; links found
  join them to a group. Later only sets of different groups are compared, so no link between groups is missed.
* Answers: a group's leader has its answers with all members: what each lacks of it and has beside it. From two
  members' differences follow the common shingles of both: with few of them, the link needs no look; else only the
  differences are compared. So every document gets its number of links, and a pair is never compared in full twice.

A list of a common shingle is dealt to several tasks, by a hash of the set; pairs of different groups, and members with
large differences, meet in blocks of bounded size.

Defined results: a null or empty text, or one without words, has no shingles, no links and is alone; equal texts link;
equal rows give equal rows and count as links of each other; a very long text is one large set, whole; an empty table
gives an empty result. The component of a row is the smallest doc_id that links reach; a null doc_id has none. Extra
columns are not read by the query and kept by ``keep_one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, filter_bits, free_name, let_through, mix64, shingle_sets, signed, text_of
from .graph import components

#: A link needs 100 * common >= PERCENT * union.
PERCENT = 80
#: At most so many of the commonest shingles have their counts sent to every task; the rest count as equally rare.
HEAVY = 400_000
#: Lists up to this long have all their pairs checked at once.
SHORT = 16
#: In longer lists a set is checked against so many predecessors.
NEAR = 4
#: Lists of shingles with more documents are dealt to tasks in parts of about so many.
PART = 2000
#: Entries of a list, and members of a group, that meet in one task: so many of each side.
BLOCK, MEMBERS = 512, 1024
#: Before sets of different groups are checked, their sketches are: counts of their shingles in so many hash ranges. The
#: common shingles are at most the sum of the lesser counts.
RANGES = 256
#: Counting: keys of 40 bits, in 2^8 to 2^20 hash ranges by the size of the texts.
_KEY_BITS, _LEAST_BITS, _MOST_BITS = 40, 8, 20


def set_key(s: np.ndarray) -> np.uint64:
    """One hash for a whole set."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) ^ s.sum(dtype=np.uint64) ^ np.uint64(len(s))
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def need(nx, ny):
    """Common shingles that a link of sets of these sizes needs."""
    return -((-PERCENT * (nx + ny)) // (100 + PERCENT))


def prefix(n: int) -> int:
    return n - (-((-PERCENT * n) // 100)) + 1


def index_prefix(n):
    """A smaller partner's shorter prefix."""
    return n - need(n, n) + 1


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, text_hash); set_id is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, s in shingle_sets(batch.column(1)):
                n[i] = len(s)
                key[i] = set_key(s) if len(s) else 0
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": n, "set_id": pa.array(signed(key), mask=n == 0), "text_hash": batch.column(2)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_id long, text_hash long")


def _new_sets(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """Each set once a task, as long as its memory of seen sets lasts."""
    seen: set[int] = set()
    for batch in batches:
        for _, s in shingle_sets(batch.column(0)):
            if len(s):
                key = set_key(s)
                if int(key) not in seen:
                    if len(seen) >= most:
                        seen.clear()
                    seen.add(int(key))
                    yield key, s


def heavy_shingles(docs: DataFrame, bound: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first 40 bits) and counts of the commonest shingles, at most ``bound`` of them, from counts over all
    documents. Counting: each task sends sorted keys in hash ranges, four bytes a key; a range has about a million keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = min(_MOST_BITS, max(_LEAST_BITS, (size // 6_000_000).bit_length()))
    low = np.uint64(_KEY_BITS - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            bucket = (keys >> low).astype(np.int64)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = np.split((keys & np.uint64((1 << int(low)) - 1)).astype(np.uint32), first[1:])
            return pa.RecordBatch.from_pydict({"bucket": bucket[first].astype(np.int32), "keys": pa.array([p.tobytes() for p in parts], pa.binary())})

        for _, s in _new_sets(batches):
            held.append(s >> np.uint64(64 - _KEY_BITS))
            n += len(s)
            if n >= max(1_000_000, 16 << bits):
                yield flush()
                held, n = [], 0
        if held and n:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, times, fresh, waiting = None, np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def fold() -> None:
            nonlocal keys, times, fresh, waiting
            new, n = np.unique(np.concatenate(fresh) if fresh else np.zeros(0, np.uint32), return_counts=True)
            both, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, times, fresh, waiting = both, np.bincount(back, np.concatenate([times, n]), len(both)).astype(np.int64), [], 0

        def table() -> pa.RecordBatch:
            nonlocal keys, times
            fold()
            few = times >= 16
            out = pa.RecordBatch.from_pydict({"key": keys[few].astype(np.int64) | (current << int(low)), "n": times[few]})
            keys, times = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            return out

        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != current and current is not None:
                    yield table()
                current = b
                fresh.append(np.frombuffer(blob.as_buffer(), np.uint32))
                waiting += len(fresh[-1])
                if waiting > 2_000_000:
                    fold()
        if current is not None:
            yield table()

    sent = text_of(docs).select("text").mapInArrow(send, "bucket int, keys binary")
    spread = sent.repartition("bucket").sortWithinPartitions("bucket")
    counts = durable(spread.mapInArrow(count, "key long, n long"), "heavy")
    total, least = counts.count(), 0
    if total > bound:  # the counts' own histogram, by eighths of a power of two, gives the threshold
        step = F.floor(F.log2("n") * 8)
        left = bound
        for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
            left -= row[1]
            if left < 0:
                least = row[0] + 1
                break
        counts = counts.where(step >= least)
    pdf = counts.toPandas().sort_values("key")
    return pdf["key"].to_numpy(np.uint64), pdf["n"].to_numpy(np.int64)


def postings(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, whole, set_id, n, pos): each set under its rarest shingles. The list of a common shingle comes in parts with tokens of
    their own; ``whole`` is the shingle then."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        out: list[tuple] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            token, parted, whole, key, n, pos = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_pydict({"token": signed(token), "whole": pa.array(signed(whole), mask=~parted), "set_id": signed(key), "n": n, "pos": pos})

        for key, s in _new_sets(batches):
            p = prefix(len(s))
            many = np.zeros(len(s), np.int64)
            if len(keys):
                short = s >> np.uint64(64 - _KEY_BITS)
                at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                many = np.where(keys[at] == short, counts[at], 0)
                order = np.lexsort((s, many))
                s, many = s[order], many[order]
            s, parts = s[:p], (many[:p] // PART + 1).astype(np.uint64)
            with np.errstate(over="ignore"):
                token = np.where(parts > 1, mix64(s + (key % parts) * np.uint64(0x9E3779B97F4A7C15)), s)
            out.append((token, parts > 1, s, np.full(p, key), np.full(p, len(many), np.int32), np.arange(p, dtype=np.int32)))
            rows += p
            if rows > 100_000:
                yield flush()
                out, rows = [], 0
        if out:
            yield flush()

    return text_of(docs).select("text").mapInArrow(run, "token long, whole long, set_id long, n int, pos int")


def _linkable(nx, px, ny, py) -> np.ndarray:
    """Whether sets with this shingle as their first common one can link; x is the smaller set."""
    return (100 * nx >= PERCENT * ny) & (px < index_prefix(nx)) & (np.minimum(nx - px, ny - py) >= need(nx, ny))


def _runs(batches: Iterator[pa.RecordBatch], most: float = 500_000) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Sorted rows in blocks that end with a whole token's list. A list longer than a block comes in parts (True, the last
    one too)."""
    held: list[np.ndarray] = []
    open_ = False
    for batch in batches:
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else part
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            # What is left of a list that was cut is at the front; it is a part too, and short lists after it are not.
            tail = int(np.searchsorted(cols[0], cols[0][0], "right")) if open_ else 0
            for part_of, lo, hi in ((True, 0, tail), (False, tail, cut)):
                if lo < hi:
                    yield [c[lo:hi] for c in cols], part_of
            open_ = False
        held = [c[cut:] for c in cols]
        if len(held[0]) > most:
            yield held, True
            held, open_ = [c[-1:] for c in held], True
    if held and len(held[0]):
        yield held, open_


def candidates(lists: DataFrame) -> DataFrame:
    """Rows of three kinds from the index: pairs to check (token null; a, b), entries of long lists (token, a = set, n, pos), and
    leaders of lists that are parts (token, a = set, b = its step of size; n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, whole, is_part, key, n, pos), cut in _runs(batches):
            twin = np.zeros(len(token), bool)
            twin[1:] = (token[1:] == token[:-1]) & (key[1:] == key[:-1])
            token, whole, is_part, key, n, pos = (x[~twin].astype(np.int64) for x in (token, whole, is_part, key, n, pos))
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[first, len(token)])
            long = np.repeat((size > SHORT) | cut, size) | (is_part == 1)
            rank = np.arange(len(token)) - np.repeat(first, size)
            pairs = []
            live = np.flatnonzero(np.repeat(size, size) > 1)
            for lag in range(1, SHORT):
                live = live[(rank[live] >= lag) & (~long[live] | (lag <= NEAR))]
                live = live[100 * n[live - lag] >= PERCENT * n[live]]  # sizes only fall further back
                if not len(live):
                    break
                hit = live[_linkable(n[live - lag], pos[live - lag], n[live], pos[live])]
                pairs.append((key[hit - lag], key[hit]))
            if long.any():
                at = np.flatnonzero(long)
                step = np.floor(np.log(np.maximum(n, 1)) * 10).astype(np.int64)
                lead = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (step[1:] != step[:-1])])
                # A leader is the set of least id, so that lists of the same sets mostly agree on it.
                by_id = np.lexsort((key, np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(token)]))))
                which, lead = np.searchsorted(lead, at, "right") - 1, by_id[lead]
                for back in (0, 1):
                    to = lead[np.maximum(which - back, 0)]
                    x, y = np.minimum(to, at), np.maximum(to, at)
                    ok = (token[to] == token[at]) & (to != at) & _linkable(n[x], pos[x], n[y], pos[y])
                    pairs.append((key[to[ok]], key[at[ok]]))
                of_part = lead[is_part[lead] == 1]
                m = len(of_part)
                yield pa.RecordBatch.from_pydict({"token": whole[of_part], "a": key[of_part], "b": step[of_part], "n": pa.nulls(m, pa.int32()), "pos": pa.nulls(m, pa.int32())})
                m = len(at)
                yield pa.RecordBatch.from_pydict({"token": np.where(is_part == 1, whole, token)[at], "a": key[at], "b": pa.nulls(m, pa.int64()), "n": n[at].astype(np.int32), "pos": pos[at].astype(np.int32)})
            if pairs:
                a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
                ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                m = ab.shape[1]
                yield pa.RecordBatch.from_pydict({"token": pa.nulls(m, pa.int64()), "a": ab[0], "b": ab[1], "n": pa.nulls(m, pa.int32()), "pos": pa.nulls(m, pa.int32())})

    spread = lists.repartition("token").sortWithinPartitions("token", "n", "set_id")
    columns = spread.select("token", F.coalesce("whole", F.lit(0)).alias("whole"), F.col("whole").isNotNull().cast("long").alias("is_part"), "set_id", "n", "pos")
    return columns.mapInArrow(run, "token long, a long, b long, n int, pos int")


def leader_pairs(found: DataFrame) -> DataFrame:
    """(a, b): each part's leaders with the one of least id of the same, and of the next lower, step of the whole list."""
    leads = found.where("token is not null and n is null").select("token", "a", F.col("b").alias("step")).distinct()
    chief = leads.groupBy("token", "step").agg(F.min("a").alias("chief"))
    near = leads.select("token", "a", F.explode(F.array("step", F.col("step") - 1)).alias("step"))
    both = near.join(chief, ["token", "step"]).where("a <> chief")
    return both.select(F.least("a", "chief").alias("a"), F.greatest("a", "chief").alias("b"))


def in_blocks(entries: DataFrame) -> DataFrame:
    """Entries (token, a, n, pos, grp) of lists in which groups meet, dealt to blocks (token, i, j): in each, entries outside the
    list's largest group (asks) meet some of all (no asks). Each side of a block has about BLOCK entries."""
    sizes = entries.groupBy("token", "grp").agg(F.count("*").alias("m"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("m", "grp")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("groups")).where("groups > 1")
    blocks = lambda m: F.ceil(m / F.lit(BLOCK)).cast("int")
    lists = lists.select("token", F.col("top.grp").alias("largest"), blocks(F.col("m") - F.col("top.m")).alias("of_i"), blocks(F.col("m")).alias("of_j"))
    spread = 8  # a list's entries are joined to what is known of it in so many tasks
    known = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    x = entries.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(spread)).cast("int")).join(known, ["token", "salt"])
    own = lambda of, seed: F.pmod(F.xxhash64(F.lit(seed), "a"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of - 1))
    cols = ["token", "i", "j", "asks", "a", "n", "pos", "grp"]
    small = x.where("grp <> largest").withColumn("i", own(F.col("of_i"), "i")).withColumn("j", every(F.col("of_j"))).withColumn("asks", F.lit(True))
    large = x.withColumn("j", own(F.col("of_j"), "j")).withColumn("i", every(F.col("of_i"))).withColumn("asks", F.lit(False))
    return small.select(cols).unionByName(large.select(cols))


def pairs_of_block(n: np.ndarray, pos: np.ndarray, m: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): of entries (n, pos) with entries (m, place) those that can link. Entries (m, place) are sorted by size and position: each
    block of one size is entered up to a position, or skipped."""
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else np.zeros(0, np.int64)
    xs, ys = [], []
    for lo, hi in zip(first, np.r_[first[1:], len(m)], strict=True):
        size = int(m[lo])
        least = need(n, size)
        x = np.flatnonzero((100 * np.minimum(n, size) >= PERCENT * np.maximum(n, size)) & (n - pos >= least))
        if len(x):
            until = np.searchsorted(place[lo:hi], size - least[x], "right")  # size - place >= least
            xs.append(np.repeat(x, until))
            ys.append(lo + np.arange(int(until.sum())) - np.repeat(np.cumsum(until) - until, until))
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns, which come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        cols = [table.column(c).to_numpy() for c in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip(np.r_[0, cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield table.slice(lo, hi - lo)
        held = (table.slice(cuts[-1]) if len(cuts) else table).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def cross_group_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups from blocks (token, i, j, asks, a, n, pos, grp, sketch); what size, position or sketches rule out
    is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # lists of the same sets give the same pairs
        for table in _blocks(batches, 3):
            asks = table["asks"].to_numpy()
            if asks.all() or not asks.any():
                continue
            a, grp = table["a"].to_numpy(), table["grp"].to_numpy()
            n, pos = table["n"].to_numpy().astype(np.int64), table["pos"].to_numpy().astype(np.int64)
            q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
            c = c[np.lexsort((pos[c], n[c]))]
            x, y = pairs_of_block(n[q], pos[q], n[c], pos[c])
            x, y = q[x], c[y]
            ok = grp[x] != grp[y]
            x, y = x[ok], y[ok]
            keep = sketch_bounds(table["sketch"].to_pylist(), x, y) >= need(n[x], n[y])
            if keep.any():
                x, y = a[x[keep]], a[y[keep]]
                new = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) - seen
                if len(seen) > 1_000_000:
                    seen.clear()
                seen |= new
                yield pa.RecordBatch.from_pydict({"a": pa.array([v for v, _ in new], pa.int64()), "b": pa.array([v for _, v in new], pa.int64())})

    spread = blocks.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return spread.select("token", "i", "j", "asks", "a", "n", "pos", "grp", "sketch").mapInArrow(run, "a long, b long")


def contents(docs: DataFrame, ids: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(id, content) of the sets asked for, and of few others, each once; ``encode`` gives a sorted set's content."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blobs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"id": signed(np.array(keys, np.uint64)), "content": pa.array(blobs, pa.binary())})

        for key, s in _new_sets(batches):
            if len(let_through(np.array([key]), shared.value)):
                keys.append(key)
                blobs.append(encode(s))
                held += len(blobs[-1])
                if held > 4_000_000:
                    yield flush()
                    keys, blobs, held = [], [], 0
        if keys:
            yield flush()

    return text_of(docs).select("text").mapInArrow(run, "id long, content binary").groupBy("id").agg(F.first("content").alias("content"))


def whole_set(s: np.ndarray) -> bytes:
    return s.tobytes()


def range_counts(s: np.ndarray) -> bytes:
    """A set's sketch: RANGES counts of one byte, of four where they don't fit."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def sketch_bounds(sketches: list[bytes], x: np.ndarray, y: np.ndarray, step: int = 50_000) -> np.ndarray:
    """For pairs of sketches, the most shingles that they can have in common."""
    counts = np.stack([np.frombuffer(b, np.uint8 if len(b) == RANGES else np.uint32).astype(np.uint32) for b in sketches])
    parts = [np.minimum(counts[x[k : k + step]], counts[y[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _full(blob: pa.Scalar) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), np.uint64)


def checked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link, by the sets' full contents. They come dealt by id and are not written, so that both joins find
    them in place."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = _full(x), _full(y)
                both = np.sort(np.concatenate([x, y]))
                ok[i] = 100 * (common := int((both[1:] == both[:-1]).sum())) >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(pa.array(ok)), "b": batch.column(1).filter(pa.array(ok))})

    known = contents(docs, _ids(pairs), whole_set)
    left = pairs.join(known.withColumnsRenamed({"id": "a", "content": "content_a"}), "a")
    both = left.join(known.withColumnsRenamed({"id": "b", "content": "content_b"}), "b").select("a", "b", "content_a", "content_b")
    return both.mapInArrow(compare, "a long, b long")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(set_id, grp) of the sets that link with others; links found (a, b), which connect each group; and groups (grp) with members in
    long lists: in the others every pair that can link was checked."""
    found = durable(candidates(postings(docs, heavy_shingles(docs))), "found")
    pairs = durable(found.where("token is null").select("a", "b").union(leader_pairs(found)).distinct(), "pairs")
    links = durable(checked(docs, pairs), "links")
    group = components(links).withColumnsRenamed({"node": "a", "component": "grp"})
    lists = found.where("token is not null and n is not null").select("token", "a", "n", "pos").join(group, "a", "left").withColumn("grp", F.coalesce("grp", "a"))
    found_lists = durable(lists, "lists")
    blocks = durable(in_blocks(found_lists), "blocks")
    sketches = contents(docs, blocks.select(F.col("a").alias("id")).distinct(), range_counts).withColumnsRenamed({"id": "a", "content": "sketch"})
    more = durable(cross_group_pairs(blocks.join(sketches, "a")).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        links = durable(links.union(checked(docs, more)), "links")
        group = components(links).withColumnsRenamed({"node": "a", "component": "grp"})
    group = durable(group.withColumnRenamed("a", "set_id"), "groups")
    open_ = durable(found_lists.select(F.col("a").alias("set_id")).distinct().join(group, "set_id").select("grp").distinct(), "open")
    discard(found, found_lists, blocks)
    return group, links, open_


def members_by_leader(docs: DataFrame, group: DataFrame, links: DataFrame, times: DataFrame) -> DataFrame:
    """(grp, set_id, n, lacks, size, times, more, diff): each member of a group, against its leader of ``size`` shingles: how many it
    lacks, and a hash list of what it lacks or has beside it. ``more``: members of the group."""
    known = durable(contents(docs, group.select(F.col("set_id").alias("id")), whole_set), "contents")
    degree = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("degree"))
    lead = group.join(degree, "set_id").groupBy("grp").agg(F.max(F.struct("degree", "set_id")).alias("lead"), F.count("*").alias("more"))
    tasks = F.ceil(F.col("more") / F.lit(MEMBERS)).cast("int")  # a group's members meet copies of its leader in so many places
    lead = lead.select("grp", "more", F.col("lead.set_id").alias("id"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"))
    lead = lead.join(known, "id").select("grp", "salt", "more", F.col("content").alias("leader"))
    sizes = group.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).alias("tasks")).where("tasks > 1")
    own = group.join(sizes, "grp", "left").withColumn("salt", F.pmod(F.xxhash64("set_id"), F.coalesce("tasks", F.lit(1))).cast("int")).select("grp", "salt", "set_id")
    rows = own.join(known.withColumnRenamed("id", "set_id"), "set_id").join(times, "set_id").join(lead, ["grp", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lacks, size, diff = [], [], [], []
            for own, leader in zip(batch.column(4), batch.column(5), strict=True):
                y, x = _full(own), _full(leader)
                gone, new = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                n.append(len(y))
                lacks.append(len(gone))
                size.append(len(x))
                diff.append(np.concatenate([gone, new]).tobytes())
            cols = {k: batch.column(i) for i, k in enumerate(("grp", "set_id", "times", "more"))}
            yield pa.RecordBatch.from_pydict(cols | {k: pa.array(v, pa.int64()) for k, v in (("n", n), ("lacks", lacks), ("size", size))} | {"diff": pa.array(diff, pa.binary())})

    return rows.select("grp", "set_id", "times", "more", "content", "leader").mapInArrow(run, "grp long, set_id long, times long, more long, n long, lacks long, size long, diff binary")


def link_counts(docs: DataFrame, group: DataFrame, links: DataFrame, open_: DataFrame, times: DataFrame) -> DataFrame:
    """(set_id, links): rows whose sets link with this one, but for its own. ``times``: (set_id, times), the rows of a set. In groups
    that are not ``open_`` (grp) all links are found.

    In the others, with x the leader, y and z lack ly and lz of it, and share c of their differences: they have size - ly - lz + c in common. So they
    link whatever c is if weight(y) + weight(z) <= (100 + PERCENT) * size, weight = PERCENT * n + (100 + PERCENT) * lacks. Two
    light members, each with half of that at most, need no look: their number is one sum a group. Heavy members meet all
    members in blocks, where c is counted for all pairs at once."""
    weight = PERCENT * F.col("n") + (100 + PERCENT) * F.col("lacks")
    ends = links.select("a", "b").union(links.select("b", "a")).withColumnsRenamed({"a": "set_id", "b": "other"})
    closed = ends.join(group.join(open_, "grp", "left_anti").select("set_id"), "set_id").join(times.withColumnsRenamed({"set_id": "other", "times": "links"}), "other").select("set_id", "links")
    members = durable(members_by_leader(docs, durable(group.join(open_, "grp", "left_semi"), "open"), links, times).withColumn("heavy", 2 * weight > (100 + PERCENT) * F.col("size")), "members")
    light = members.where("not heavy").groupBy("grp").agg(F.sum("times").alias("all"))
    known_links = members.where("not heavy").join(light, "grp").select("set_id", (F.col("all") - F.col("times")).alias("links"))
    blocks = F.ceil(F.col("more") / F.lit(MEMBERS)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "set_id"), blocks).cast("int")
    heavy_groups = members.where("heavy").select("grp").distinct()
    every = lambda: F.explode(F.sequence(F.lit(0), blocks - 1))
    cols = ["grp", "i", "j", "asks", "set_id", "n", "lacks", "size", "times", "heavy", "diff"]
    ask = members.where("heavy").withColumn("i", own).withColumn("j", every()).withColumn("asks", F.lit(True))
    other = members.join(heavy_groups, "grp", "left_semi").withColumn("j", own).withColumn("i", every()).withColumn("asks", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, 3):
            asks = table["asks"].to_numpy()
            q, z = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(q) or not len(z):
                continue
            ids, n, lacks, times = (table[c].to_numpy() for c in ("set_id", "n", "lacks", "times"))
            heavy, size = table["heavy"].to_numpy(), int(table["size"][0].as_py())
            diffs = [_full(x) for x in table["diff"]]
            row = np.repeat(np.arange(len(ids)), [len(x) for x in diffs])
            token = np.unique(np.concatenate(diffs), return_inverse=True)[1] if len(row) else np.zeros(0, np.int64)
            top = int(token.max()) + 1 if len(token) else 0
            shared = (np.bincount(token[asks[row]], minlength=top) > 0) & (np.bincount(token[~asks[row]], minlength=top) > 0)
            on = shared[token]
            row, token = row[on], (np.cumsum(shared) - 1)[token[on]]
            place = np.where(asks, np.cumsum(asks), np.cumsum(~asks)) - 1
            common = np.zeros((len(q), len(z)), np.float32)
            order = np.argsort(token, kind="stable")
            row, token = row[order], token[order]
            for lo in range(0, int(shared.sum()), 4096):
                a, b = np.searchsorted(token, (lo, lo + 4096))
                if a == b:
                    continue
                left, right = np.zeros((len(q), 4096), np.float32), np.zeros((len(z), 4096), np.float32)
                r, t = row[a:b], token[a:b] - lo
                left[place[r[asks[r]]], t[asks[r]]] = 1
                right[place[r[~asks[r]]], t[~asks[r]]] = 1
                common += left @ right.T
            have = size - lacks[q][:, None] - lacks[z][None, :] + common.astype(np.int64)
            link = (have >= need(n[q][:, None], n[z][None, :])) & (ids[q][:, None] != ids[z][None, :])
            gain = link @ times[z]
            back = times[q] @ link * ~heavy[z]  # a heavy member asks for itself
            yield pa.RecordBatch.from_pydict({"set_id": np.concatenate([ids[q], ids[z]]), "links": np.concatenate([gain, back]).astype(np.int64)})

    met = ask.select(cols).unionByName(other.select(cols)).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "set_id long, links long")
    return closed.unionByName(known_links).unionByName(met).groupBy("set_id").agg(F.sum("links").alias("links"))


def named_groups(sets: DataFrame, group: DataFrame) -> DataFrame:
    """(set_id, component_id, grp) of each set; ``grp`` names a component also where no row has a doc_id."""
    named = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    owned = named.join(group, "set_id", "left").select("set_id", "least", F.coalesce("grp", "set_id").alias("grp"))
    least = owned.groupBy("grp").agg(F.min("least").alias("component_id"))
    return durable(owned.join(least, "grp").select("set_id", "component_id", "grp"), "known")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, n_links (other rows that link with it), set_id (null: no shingles)."""
    sets = durable(document_sets(docs), "sets")
    group, links, open_ = linked_sets(docs)
    times = durable(sets.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("times")), "times")
    counts = durable(link_counts(docs, group, links, open_, times), "counts")
    known = named_groups(sets, group).join(times, "set_id").join(counts, "set_id", "left")
    joined = sets.join(known, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("times") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), "set_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that lead their component: of its texts with the smallest doc_id (rows without one
    come last) one by a hash of the text, once if rows repeat. Rows of different texts stay apart if their doc_id is the
    same. Rows without a doc_id and without words stay."""
    sets = durable(document_sets(docs), "sets")
    known = named_groups(sets, linked_sets(docs)[0])
    row = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    lead = sets.where("set_id is not null").join(known.select("set_id", "grp"), "set_id").groupBy("grp").agg(row.alias("row")).select("row.doc_id", "row.text_hash")
    alone = sets.where("set_id is null and doc_id is not null").select("doc_id", "text_hash")
    own, lead_id, lead_hash = (free_name(docs, x) for x in ("text_hash", "lead_id", "lead_hash"))
    lead = lead.union(alone).distinct().withColumnsRenamed({"doc_id": lead_id, "text_hash": lead_hash})
    hashed = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(lead_id)) & (F.col(own) == F.col(lead_hash))
    unique = hashed.join(lead, same, "left_semi").dropDuplicates(["doc_id", own]).select([F.col(f"`{c}`") for c in docs.columns])
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return unique.unionByName(docs.where(F.col("doc_id").isNull() & wordless))
