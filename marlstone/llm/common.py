"""Shared helpers: Arrow batches in bounded slices, vectorised word hashing, checkpoints and samples.

A *word* is a maximal run of bytes that are not separators. Two separator sets exist: ``SPACE`` (ASCII white
space) and ``NONWORD`` (every ASCII byte that is neither letter nor digit, so punctuation never sticks to words;
bytes of other scripts count as letters). All hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
WORD_BASE, BYTE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BLOCK = 1 << 19  # bytes hashed at a time; bounds the temporary arrays
BATCH_BYTES = 4 << 20  # text bytes that one slice of an Arrow batch holds (a longer document makes a slice alone)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NONWORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Tables of base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 5 * self.n // 4, 1 << 16)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up[:n], self.down[:n]


    def free(self) -> None:
        self.n, self.up, self.down = 0, _powers(self.base, 1), _powers(self.inverse, 1)


_bytes_pow, _words_pow = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


@functools.cache
def _allocator() -> ctypes.CDLL | None:
    """The C library, told to give blocks of 4 MB and more back to the system as they are freed; None without glibc."""
    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:
        return None
    libc.mallopt(-3, 4 << 20)
    return libc


def lean(work: Callable) -> Callable:
    """A kernel over batches whose worker, which Spark keeps for later tasks, gives its memory back at the end."""

    @functools.wraps(work)
    def run(batches):
        libc = _allocator()
        try:
            yield from work(batches)
        finally:
            _bytes_pow.free()
            _words_pow.free()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return run


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most ``limit`` bytes of text or one row."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets of the rows in them."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = sep[raw]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], before[0] = space[:-1], True
    after[:-1], after[-1] = space[1:], True
    inner = off[(off > 0) & (off < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, made in blocks of whole words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _bytes_pow.upto(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_CODE[raw[a:b]] * up[:-1], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Grams:
    """Hashes of runs of words at any length from one pass of running sums."""

    def __init__(self, words: np.ndarray):
        up, self.down = _words_pow.upto(len(words) + 1)
        self.total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:-1], out=self.total[1:])

    def at(self, first: np.ndarray, n) -> np.ndarray:
        return mix((self.total[first + n] - self.total[first]) * self.down[first])

    def all(self, n: int) -> np.ndarray:
        """Of the runs of n words that start at each position; runs may cross rows."""
        if len(self.total) - 1 < n:
            return np.zeros(0, np.uint64)
        return mix((self.total[n:] - self.total[:-n]) * self.down[: len(self.total) - n])


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block prefixes and suffixes."""
    n = len(x)
    if n < w:
        return x[:0]
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def encode_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, a code for each white-space separated word, and the distinct words by code. Null is empty."""
    parts = pc.utf8_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets, flat = offsets - offsets[0], parts.flatten()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # before leading and after trailing white space, and all of an empty text
        kept = np.concatenate([[0], np.cumsum(~empty)])
        offsets, flat = kept[offsets], flat.filter(pa.array(~empty))
    coded = (flat.cast(pa.string()) if flat.nbytes < 1 << 31 else flat).dictionary_encode()  # 32-bit offsets are faster
    return offsets, coded.indices.to_numpy(), coded.dictionary


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by row; an empty row gives 0. Works along the first axis."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=out.dtype)
    return out


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so a lost executor costs no upstream work."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="marlstone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns; whatever else a table has cannot clash with what an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for temporary use: the given ones, lengthened until the table has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def filtered(df: DataFrame, keep: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text is kept, all columns as they were, whatever their names. ``keep`` is called once in
    a task and gives the function that judges slices, which have a column ``text``."""
    safe = ["text" if n == "text" else f"c{i}" for i, n in enumerate(df.columns)]

    def work(batches):
        judge = keep()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(judge(part), pa.bool_()))

    renamed = df.toDF(*safe)
    return renamed.mapInArrow(lean(work), renamed.schema).toDF(*df.columns)


def sample_ids(df: DataFrame, key: str, rows: int, salt: int = 7) -> DataFrame:
    """At most ``rows`` distinct keys, the lowest by hash, found without sorting the table."""
    keys = df.select(F.col(key)).where(F.col(key).isNotNull())
    n = keys.count()
    hashed = keys.withColumn("_h", F.xxhash64(F.col(key), F.lit(salt)))
    if n > 4 * rows:
        limit = int(-(2**63) + 2**64 * (2 * rows + 50) / n)
        hashed = hashed.where(F.col("_h") <= F.lit(limit))
    return hashed.distinct().orderBy("_h", key).limit(rows).select(key)


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold 2,000 rows where the session has Spark's default of 10,000: whole texts come in them, and
    a worker and its executor hold a batch or two each at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
