"""What the corpus operators share: shared-folder tables, text batches as byte arrays, hashing.

Text batches are handled as one flat byte array with document offsets, so
tokenising, hashing and table lookups are numpy operations over many documents
at once, in pieces of a bounded number of bytes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19
_LOCAL: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one temporary folder on a single machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="tracemill-"))
    return root.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tracemill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path_ = path
    for made in _SCOPES:
        made.append(out)
    return out


@contextmanager
def tables_freed():
    """Within, tables are noted that cut writes; at the end all are deleted but those that are taken out of the list it gives."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        release(*made)


def one_each(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with one row (the first by a hash of all columns) of each row key in repeated (row_); all other rows stay."""
    names = docs.columns
    key, held = (x + "_" * max(map(len, names)) for x in ("key", "held"))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    some = repeated.select(F.col("row_").alias(held)).distinct()
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(F.to_json(F.struct(n)) for n in names))))
    single = keyed.join(some, keyed[key] == some[held], "left_anti").select(*names)
    return single.unionByName(keyed.join(some, keyed[key] == some[held], "left_semi").withColumn(held, first).where(F.col(held) == 1).select(*names))


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Within, shuffle files are deleted once the job that wrote them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path_)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key():
    """A hash of id and text: rows that share both count as one document, rows that share an id only do not."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def crc_fold(doc_id, mod: int):
    """crc32 of the id as text, modulo mod; null ids fall in no fold (null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def in_fold(doc_id, mod: int, fold: int):
    return F.coalesce(crc_fold(doc_id, mod) == fold, F.lit(False))


def trim() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system: a task's peak is then its own."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that a piece has about limit bytes of text, and one row at least."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts (null: empty) and the offsets of the documents in them."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the document of each; between: whether a byte stands between words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = between[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    before[heads] = True
    after = np.empty_like(space)
    after[-1] = True
    after[:-1] = space[1:]
    after[heads[heads > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWER: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWER[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWER[k] = np.cumprod(p, dtype=np.uint64)
    return _POWER[0][:n], _POWER[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit permutation (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for all spans, from prefix sums of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, back = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
