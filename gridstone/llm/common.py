"""Shared helpers: durable intermediate tables and vectorised word hashing over Arrow text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets one;
    on a cluster this raises, as executors would each write to their own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm.get() if jvm.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


#: Shuffle files go when the query that wrote them ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor costs a reread of the table, never a recomputation of what led to it; the shuffle files of the
    write are therefore not needed once it is done, and are removed. So is native memory that the driver's JVM freed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans and compiled classes of finished queries, which a heap with room left keeps."""
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Give native memory that the driver's JVM freed back to the system; what the JVM says of it, empty if it knows no such command.

    Compilers and hundreds of short-lived Spark threads allocate from as many arenas of the C library as there are cores times
    eight, and these keep freed pages: over a hundred megabytes outside the heap after some dozen queries.
    """
    gateway, lang = spark.sparkContext._gateway, spark._jvm.java.lang
    find = lang.Class.forName

    def array(kind: object, *items: object) -> object:
        out = gateway.new_array(kind, len(items))
        for i, item in enumerate(items):
            out[i] = item
        return out

    try:
        kinds = [find(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = find("javax.management.MBeanServerConnection").getMethod("invoke", array(lang.Class, *kinds))  # the server's own class is not open
        command = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(invoke.invoke(server, array(lang.Object, command, "systemTrimNativeHeap", array(lang.Object), array(lang.String))))
    except Py4JError:  # another JVM or an older one
        return ""


# --- word hashing -------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
#: Bytes of a word from which it is hashed whole instead of in blocks of eight.
_LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Bytes of white space that part words: space and \x09-\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part alphanumeric words: all of ASCII but digits and letters.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (a bijection)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``: every eight bytes are mixed in by a bijection, and so is the length."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(_BASE))
    live = np.arange(len(start))
    long = size > _LONG
    if long.any():
        live = live[~long]
        for i in np.flatnonzero(long).tolist():
            h[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes())
    at = 0
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (eight[start[live] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    return h


def _hash_piece(buf: np.ndarray, cuts: np.ndarray, separators: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of ``buf``; a word ends at a separator or a cut."""
    n = len(buf)
    inside = ~separators[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[(cuts > 0) & (cuts <= n)] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, hash_spans(_LOWER[buf] if fold else buf, start, end)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; a null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(column: pa.Array, separators: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, then start, end and hash of each word (A-Z lower-cased if ``fold``), then n + 1 offsets into those.

    Works on about one megabyte at a time; a longer text is cut at separators only.
    """
    buf, offsets = text_buffer(column)
    n = len(buf)
    starts, stops, hashes, at = [], [], [], 0
    while at < n:
        stop = min(n, at + _PIECE)
        while stop < n and not separators[buf[stop - 1]]:
            after = np.flatnonzero(separators[buf[stop : stop + _PIECE]])
            stop = stop + int(after[0]) + 1 if len(after) else min(n, stop + _PIECE)
        low, high = np.searchsorted(offsets, (at, stop))
        start, end, h = _hash_piece(buf[at:stop], offsets[low : high + 1] - at, separators, fold)
        starts.append(start + at)
        stops.append(end + at)
        hashes.append(h)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return buf, start, join(stops, np.int64), join(hashes, np.uint64), np.searchsorted(start, offsets).astype(np.int64)


def word_hashes(column: pa.Array, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, and n + 1 offsets into them; see ``word_spans``."""
    return word_spans(column, separators)[3:]


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words; of the whole sequence if there are fewer words, of none if there is none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_BASE) + words[i : len(words) - size + 1 + i] + np.uint64(i + 1))
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (or one longer row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_buffer(column) if column.null_count == 0 else text_buffer(column.fill_null(""))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop
