"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SPACE_FREE = rf"[^{SPACE}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a batch that goes to a Python worker: a batch of long texts so holds fewer rows, whatever the session's row limit.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, where it has no closer bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str((1 << 31) - 1)).rstrip("bB") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one of this machine only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
            current = context._jsc.sc().getCheckpointDir()
        at = current.get()
    return at.rstrip("/")


#: Paths of the tables that cut() has made, in order.
made: list[str] = []


def release(spark: SparkSession, paths: list[str], docs: DataFrame | None = None) -> None:
    """Delete tables that nothing reads any more; those that docs still reads stay."""
    if not paths:
        return
    read = {str(f).rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in docs.inputFiles()} if docs is not None else set()
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def cut(df: DataFrame, mark: Column | None = None) -> DataFrame | tuple[DataFrame, tuple]:
    """The same rows read back from a Parquet table in the shared folder: later reads don't repeat the work,
    and a lost executor costs no more than its own tasks.  The table goes when the application ends.

    Rows are counted while they are written (work done anew after a loss may count twice, so a count is
    never too low).  With a mark, an aggregate, (count, mark) comes along.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), (F.lit(0) if mark is None else mark).alias("mark")).write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = seen.get["rows"]
    return out if mark is None else (out, (seen.get["rows"], seen.get["mark"]))


def count_runs(text: Column, between: str) -> Column:
    """How many runs a text has of characters other than those of the class `between` (null: 0): pieces between matches, less empty ones at the ends."""
    pieces_ = F.size(F.split(text, f"[{between}]+", -1))
    ends = text.rlike(f"^[{between}]").cast("int") + F.substring(text, -1, 1).rlike(f"[{between}]").cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(pieces_ - ends).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table has such a column already (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; one that has been cut was counted then."""
    known = df.__dict__.get("_rows")
    return (df.count() if known is None else known) <= rows


def hint_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only after its size has been checked; beyond the bound the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def give_back() -> None:
    """Return to the system what earlier batches have left free: workers live on between stages, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _trimmer() -> Callable[[int], int] | None:
    """The C library's function for that, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


_trim = _trimmer()


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many bytes in one column (a longer row comes alone), in order."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def by_pieces(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, most: int = 1 << 20):
    """A function for mapInArrow that does its work on pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, most):
                yield work(piece)

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, from sorted batches; a group may span batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        data = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(data.column(k)[a].as_py() for k in keys)
            if held and key != held_key:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held_key = key
            held.append(data.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
