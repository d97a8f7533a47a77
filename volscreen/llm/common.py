"""Shared helpers: the folder that all executors see, staged tables, numpy word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this subpackage has it.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker holds at once inside small_batches (one larger row stands alone).
BATCH_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in one process is a temporary folder set;
    on a cluster a missing setting is an error, since executors share no local disk.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="volscreen-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a write go when it ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, rows go to Python workers in batches of BATCH_BYTES; all of them go, whole."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again; the shuffle files of the write go when it ends."""
    with tidy_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, path: str, buckets: int | None = None) -> DataFrame:
    """``df`` written to ``path`` in buckets of ``key``, sorted by it: equal joins on ``key`` do not shuffle it again.

    The catalogue is used for the writing alone: no table is left in it.
    """
    spark, n = df.sparkSession, buckets or partitions(df.sparkSession)
    name = f"staged_{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return _taken_off(spark, name)


def reopened(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> DataFrame:
    """A table that ``bucketed`` wrote, in this session or an earlier one."""
    name = f"staged_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return _taken_off(spark, name)


def _taken_off(spark: SparkSession, name: str) -> DataFrame:
    """The external table as a DataFrame; the catalogue forgets it, the files stay."""
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` whose writing has ended, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n.getName() for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each changed where ``columns`` has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    return stored(df, staged_path(df.sparkSession, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- numpy word hashing -------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers by salt: of a word's bytes and of a sequence's words.
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_GRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Words of more bytes have a digest.
SHORT = 48
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (splitmix64's) on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_table(lower: bool, base: np.uint64) -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * base)
    if lower:
        t[65:91] = t[97:123]
    return t


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of many texts at once; ``lower`` folds A-Z, ``salt`` (0, 1) gives other hashes.

    A polynomial over the bytes of words of at most SHORT bytes.  Long enough words can be built that
    collide under any polynomial modulo 2**64, so longer ones have a keyed BLAKE2b digest.
    """

    def __init__(self, lower: bool = False, salt: int = 0):
        self.lower, self.key = lower, b"words-%d" % salt
        self.base = _BASE[salt]
        self.table = _byte_table(lower, self.base)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 20)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts one after another, and each text's first word (and the end)."""
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self._grow(len(buf) + 1)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts] if len(starts) else np.zeros(0, np.uint64)
        h = mix64(h + (ends - starts).astype(np.uint64))
        for i in np.flatnonzero(ends - starts > SHORT).tolist():
            word = buf[starts[i] : ends[i]].tobytes()
            digest = hashlib.blake2b(word.lower() if self.lower else word, digest_size=8, key=self.key).digest()
            h[i] = int.from_bytes(digest, "little")
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return h, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of every n words that follow one another (across texts too: mask those); ``salt`` is 0 or 1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n + 1 + (salt << 8)), np.uint64)
    for j in range(n):
        h *= _GRAM[salt]
        h += words[j : j + m]
    return mix64(h)


def text_blocks(texts: list[bytes | None], limit: int = 1 << 20):
    """Index ranges of texts of about ``limit`` bytes together (one longer text stands alone)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        k = len(t or b"")
        if i > begin and size + k > limit:
            yield begin, i
            begin, size = i, 0
        size += k
    if begin < len(texts):
        yield begin, len(texts)


def release() -> None:
    """Give freed memory back to the system; a Python worker lives on from stage to stage."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``, whose worker keeps no freed memory once a task has ended."""

    def all_of(batches):
        yield from run(batches)
        release()

    return all_of


def as_bytes(array) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()
