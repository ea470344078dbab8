"""Helpers shared by the operators: column names, tables on shared storage,
size-checked broadcasts and packed arrays."""

from __future__ import annotations

import tempfile
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: A table joined with a broadcast hint has at most this many rows; above it the
#: join is a shuffled one that adaptive execution may split.
BROADCAST_ROWS = 20_000

#: Words are the runs of bytes between these, as the class is written in a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes that go to Python at a time: an executor's Python workers and the buffers that
#: feed them then need tens of megabytes, not hundreds.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to :data:`BATCH`, unless it has its own setting."""
    for key, (default, wanted) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, wanted)


def fresh(taken, *wanted: str) -> list[str]:
    """``wanted`` names, lengthened where they collide with ``taken`` (case-insensitively)."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


#: A file of at most so many bytes that has fewer row groups than there are cores is dealt out before use.
SMALL_TABLE = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.

    A small table in one or two row groups would keep most cores idle; one of at most
    :data:`SMALL_TABLE` bytes is dealt out over the cores first.  No larger one is ever moved.
    """
    df, cores = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL_TABLE and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own setting.

    Where that is unset, a local folder serves a local master; any other master is refused,
    since its executors would write to disks of their own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: What :func:`stored` has written and nobody has deleted yet, by application.
_STORED: dict[str, set[str]] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/marlstone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._marlstone_path = path
    _STORED.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.get(spark.sparkContext.applicationId, set()).discard(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later step reads."""
    for df in frames:
        path = getattr(df, "_marlstone_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Delete all tables that operators have stored in this application; their number.

    Results read such tables until they are written or collected, so call it after that.
    """
    paths = list(_STORED.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def small_join(df: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a broadcast hint if ``small`` is counted to have few rows, else with a shuffle."""
    rows = small.count() if rows is None else rows
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str, remainder: int = 0, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def utf8_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def by_bytes(offsets: np.ndarray, most: int):
    """Consecutive row ranges (start, stop) of at most ``most`` bytes, or of one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        stop = min(stop, n)
        yield start, stop
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_K1, _K2, _K3, _K4 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
#: Spans of more bytes than this are hashed by BLAKE2b, one by one.
LONG = 64


def eights(raw: np.ndarray) -> np.ndarray:
    """At each byte, and behind the last one, the eight bytes from there on as a number; zeros follow the end."""
    return np.ndarray(len(raw) + 1, "<u8", raw.tobytes() + bytes(8), strides=(1,))


def span_hash(eight: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, stop) of the bytes of :func:`eights`; depends on the span's bytes alone.

    Eight bytes at a time go into two states of 64 bits, one by xor and one by sum, each mixed
    after every step; long spans get a cryptographic hash.
    """
    size = np.asarray(stop - start)
    start = np.asarray(start)

    def step(a, b, lane):
        return mix64(a ^ lane), (c := (b + lane) * _K3) ^ (c >> np.uint64(29))

    with np.errstate(over="ignore"):
        a = size.astype(np.uint64) * _K1
        b = a + _K2
        a, b = step(a, b, eight[start] & _MASK[np.minimum(size, 8)])
        at, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(at):
            a[at], b[at] = step(a[at], b[at], eight[start[at] + done] & _MASK[np.minimum(size[at] - done, 8)])
            done += 8
            at = at[size[at] > done]
        out = mix64(a + b * _K4)
    far = np.flatnonzero(size > LONG)
    if len(far):
        raw = memoryview(eight.base if isinstance(eight.base, bytes) else eight.tobytes())
        out[far] = [int.from_bytes(blake2b(raw[x:y], digest_size=8).digest(), "little") for x, y in zip(start[far].tolist(), stop[far].tolist())]
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each word; a row's end also ends a word."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    stop = np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def append_arrow(df: DataFrame, inputs: list[str], fields, make, keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns made in Arrow batches.

    ``make()`` is called once a task and returns a function from the arrays of ``inputs`` to
    the arrays of ``fields`` (a list of (name, Spark type)).  ``keep``: the columns of ``df``
    to carry along (all by default).  A carried column that has the name of a new one gives way.
    """
    small_batches(df.sparkSession)
    new = {name.lower() for name, _ in fields}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    alias = fresh(carried, *(f"in{i}__" for i in range(len(inputs))))
    wide = df.select(*(F.col(f"`{c}`") for c in carried if c not in inputs), *(F.col(f"`{c}`").alias(a) for c, a in zip(inputs, alias)))
    back = dict(zip(inputs, alias))
    schema = df.select(*(F.col(f"`{c}`") for c in carried)).schema
    for name, kind in fields:
        schema = schema.add(name, DataType.fromDDL(kind))

    def run(batches):
        work = None
        for batch in batches:
            work = work or make()
            made = work(*(batch.column(batch.schema.get_field_index(a)) for a in alias))
            old = [batch.column(batch.schema.get_field_index(back.get(c, c))) for c in carried]
            yield pa.RecordBatch.from_arrays([*old, *made], [*carried, *(n for n, _ in fields)])

    return wide.mapInArrow(run, schema)


#: Hashes are drawn by their remainder modulo this: fine enough for a few rows of 10**14.
DRAW = 10**15


def drawn(most: int, n: int, seed: int, *columns: str) -> Column:
    """Whether a row is among about ``most`` of ``n`` rows, by a seeded hash of ``columns``; some are, however large ``n``."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(DRAW)) < DRAW * most // n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int) -> DataFrame:
    """A stored sample (text, y) of at most about ``most`` labelled documents outside the held-out fold.

    One row for each doc_id (the smallest text and the largest label, if an id repeats), drawn
    by a seeded hash of the id; rows with a null id, text or label take no part.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > most:
        known = known.filter(drawn(most, n, seed, "doc_id"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).dropna()
    found = small_join(texts, known, "doc_id", rows=min(n, most))
    return stored(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "sample")


def distinct(a: np.ndarray) -> np.ndarray:
    """Distinct values, ascending: by sorting, which is several times faster here than by hashing."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]
