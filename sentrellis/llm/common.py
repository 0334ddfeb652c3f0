"""Shared helpers of the training-data operators: shared storage, tokenising in Arrow batches, text chunks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: ASCII white space, and a run of anything else: what "word" means in every operator here.
WS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that a Python worker turns into arrays at a time.
CHUNK_BYTES = 2 << 20
#: Input bytes for each partition of a shuffle that carries corpus-sized data.
PARTITION_BYTES = 10 << 20
#: Rows and bytes of an Arrow batch; documents can be long.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, and a cluster one below its warehouse, which is shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = tempfile.mkdtemp(prefix="sentrellis-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, has known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sentrellis/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for these files goes once they are written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete files of ``materialise`` that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row(own: DataFrame, more: str) -> StructType:
    """The schema of ``row``, as in ``own``, and further columns; names in ``row`` can be of any kind."""
    return StructType([own.schema["row"], *StructType.fromDDL(more).fields])


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, and bound their Arrow batches: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_sentrellis_sent", False):
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="sentrellis-code-"), f"{root.name}-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(path))
        context._sentrellis_sent = True


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of corpus-sized data: by the planner's size of the input, the session's number at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(size // PARTITION_BYTES, 200_000) if size < 1 << 50 else own)


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts of an Arrow string column as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``; one longer row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def unpack(packed: bytes, n: int) -> list[bytes]:
    """The ``n`` parts that were packed."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes, at, out = np.frombuffer(raw, np.int64, n), 8 * n, []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def planes(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, first bytes first: those that are mostly alike lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(k, -1).T).view(kind).ravel()


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(1 << max(16, (n - 1).bit_length()), np.uint64)
        out[0] = 1
        done = 1
        while done < len(out):
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many spans: a polynomial hash from one running sum, then mixed."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
    out = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in WS]] = True


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buffer]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time are mixed into the hash so far; of long words, XXH64."""
    size = (ends - starts).astype(np.uint64)
    windows = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))  # the eight bytes from each place on
    out = mix(size * np.uint64(0xD6E8FEB86659FD93) + np.uint64(_BASE))
    some, at = slice(None), starts
    rest = np.minimum(size, np.uint64(LONG_WORD))
    while len(at):
        last = np.minimum(rest, np.uint64(8)) * np.uint64(8)
        block = windows[at] & (np.uint64(_MASK) >> (np.uint64(64) - last))
        out[some] = mix(out[some] ^ block)
        more = rest > 8
        at, rest = at[more] + 8, rest[more] - np.uint64(8)
        some = np.flatnonzero(more) if isinstance(some, slice) else some[more]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


class Words:
    """Words of several texts: bytes, spans, hashes and the index of each word's text."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        self.bytes = b"\n".join(texts)
        self.buffer = np.frombuffer(self.bytes, np.uint8)
        self.starts, self.ends = word_spans(self.buffer)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(self.starts, at)
        self.counts = np.diff(first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = word_hashes(self.bytes, self.starts, self.ends) if hashed else np.zeros(len(self.starts), np.uint64)
