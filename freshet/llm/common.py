"""Shared helpers: written tables that cut lineage, and vectorised work on Arrow text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The C library's call, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_OWN_DIR: dict[str, str] = {}
_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Bytes that separate words.
WHITESPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _OWN_DIR.setdefault("dir", tempfile.mkdtemp(prefix="spark-freshet-"))
    return base.rstrip("/")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later stages survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/freshet-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote, once all that reads them is written. What a result still reads stays in the shared
    folder, for the caller to clear when it is done with."""
    for df in tables:
        where = _PATH_OF.pop(df, None)
        if where:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_bits(ids: DataFrame, least: int = 20, most: int = 30) -> tuple[np.ndarray, int]:
    """A bit map over the first bits of 64-bit hashes (id), and how many bits: about 16 places a hash, 128 MB at most however many
    there are. What it lets through by chance is sorted out later."""
    bits = min(most, max(least, (16 * ids.count()).bit_length()))
    v = ids.select(F.shiftrightunsigned("id", 64 - bits).alias("v"))
    maps = v.groupBy(F.bitmap_bucket_number(F.col("v") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("v") + 1)).alias("map"))
    out = np.zeros(max(4096, 1 << (bits - 3)), np.uint8)
    for row in maps.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.map, np.uint8)
    return out, bits


def let_through(hashes: np.ndarray, wanted: tuple[np.ndarray, int]) -> np.ndarray:
    """Places of the hashes (unsigned) whose bit is set."""
    v = (hashes >> np.uint64(64 - wanted[1])).astype(np.int64)
    return np.flatnonzero(wanted[0][v >> 3] >> (v & 7).astype(np.uint8) & 1)


def text_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are not read."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def spread_windows(text: Column, windows: int = 64, size: int = 1024) -> Column:
    """``text``, or if it has more than windows * size characters, so many windows of that size, spread evenly from its start to its end."""
    gap = (F.length(text) - size).cast("double") / (windows - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(text, F.floor(i * gap).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > windows * size, F.array_join(cut, " ")).otherwise(text)


class TextBlock:
    """Some rows of an Arrow text column as one byte array: ``data``, and row i at offsets[i]:offsets[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.rows = data, offsets, first, len(offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_blocks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[TextBlock]:
    """Blocks of whole rows with about ``most`` bytes each; a longer row is a block of its own. Nulls are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    first = 0
    for chunk in chunks:
        n = len(chunk)
        if not n:
            continue
        if chunk.null_count:
            chunk = pc.fill_null(chunk.cast(pa.large_binary()), b"")
        _, off, data = chunk.buffers()  # the batch's own bytes, no copy
        kind = np.int64 if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type) else np.int32
        offsets = np.frombuffer(off, kind, n + 1, chunk.offset * np.dtype(kind).itemsize).astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield TextBlock(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], first + i)
            i = j
        first += n
    give_back()


def give_back() -> None:
    """Return memory that a worker has freed to the machine: workers live on from stage to stage, and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WHITESPACE)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Words:
    """Words of a block: starts and ends in its bytes, and ``row_at``: words of row i are row_at[i]:row_at[i+1]."""

    def __init__(self, block: TextBlock):
        data, off = block.data, block.offsets
        solid = ~_IS_SPACE[data]
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        inner = off[(off > 0) & (off < len(data))]
        before[inner] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        after[inner - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.row_at = np.searchsorted(self.starts, off)
        self.solid = solid
        self.block = block

    def hashes(self, lower: bool = False, piece: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word; A-Z count as a-z if ``lower``."""
        table = _BYTE_LOWER if lower else _BYTE
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(out)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + piece, "right")))
            s, length = self.starts[i:j], self.ends[i:j] - self.starts[i:j]
            at = np.zeros(len(s), np.int64)
            np.cumsum(length[:-1], out=at[1:])
            within = np.arange(int(length.sum())) - np.repeat(at, length)
            terms = table[self.block.data[within + np.repeat(s, length)]] * _powers(_BASE, int(length.max()))[within]
            out[i:j] = np.add.reduceat(terms, at) + length.astype(np.uint64)
            i = j
        return mix64(out)


_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def windows5(h: np.ndarray) -> np.ndarray:
    """Hashes of all windows of five words; window i has words i to i + 4 (rows are not looked at)."""
    n = len(h) - 4
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(n, np.uint64)
    for k, m in enumerate(_MULT):
        x += h[k : k + n] * m
    return mix64(x)


def short_sequence(h: np.ndarray) -> np.ndarray:
    """The whole sequence of one to four words as one hash."""
    x = np.uint64(len(h))
    for k in range(len(h)):
        x = x + h[k] * _MULT[k]
    return mix64(np.array([x ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its five-word shingles) for each row; A-Z are lower-cased."""
    with np.errstate(over="ignore"):
        for block in text_blocks(column):
            words = Words(block)
            h = words.hashes(lower=True)
            w = windows5(h)
            for i in range(block.rows):
                a, b = words.row_at[i], words.row_at[i + 1]
                if b - a >= 5:
                    yield block.first + i, np.unique(w[a : b - 4])
                elif b > a:
                    yield block.first + i, short_sequence(h[a:b])
                else:
                    yield block.first + i, np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
