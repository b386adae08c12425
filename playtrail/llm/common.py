"""Pieces that several text operators use."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playtrail.session import scratch

# Fixed value: the table path of every registered query is `<sf_dir>/<name>.parquet`.
TABLE = "{dir}/{name}.parquet"

# Rows whose crc32 of the id leaves this remainder are held out from learning.
FOLDS = 3
HELD_OUT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(TABLE.format(dir=sf_dir.rstrip("/"), name=name))


def shipped(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same function, which first sends this package to the executors of the session it is
    given, once: they may run from other folders or on other machines."""

    def call(spark: SparkSession, *rest):
        context = spark.sparkContext
        if not getattr(context, "_playtrail_shipped", False):
            home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
            base = os.path.join(tempfile.mkdtemp(prefix="playtrail-"), "playtrail_package")
            context.addPyFile(shutil.make_archive(base, "zip", home, "playtrail"))
            context._playtrail_shipped = True
        return function(spark, *rest)

    return call


_KEPT: dict = {}


def kept(key, make: Callable[[], object]):
    """What this worker has made for the key in an earlier task. It keeps the last one only, so the
    operators of a pipeline do not pile up their tables in one process."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what this worker has kept, and its memory with it."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can: otherwise the worker holds
    what its largest task once took, beside all that the executor needs for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares for checkpoints. Where the session names none,
    it is below a temporary folder on one machine, and an error on a cluster."""
    return scratch(spark, name)


# What stages read and change; all other columns are only handed on.
STAGE_COLUMNS = ("doc_id", "text", "n_chars")


def own_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same stage, to which columns may have any names: those it does not know get names that
    none of its own have, and their old ones back."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        inner = [n if n in STAGE_COLUMNS else f"extra_{i}" for i, n in enumerate(names)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*names)

    return call


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of `df` from a reliable checkpoint, which outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def fold(id_column: Column) -> Column:
    """0, 1 or 2 from the id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int
) -> list[tuple[int, bytes, int]]:
    """Training rows on the driver: at most `rows_per_class` labelled rows of each class, whole
    texts, never of the held-out fold, drawn by a hash of the id. Rows without an id, label or
    document are left out; a label given twice counts twice. The two limits bound what is broadcast
    and collected whatever the size of the tables."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id", label)
    order = (F.xxhash64(F.lit("draw"), "doc_id"), F.col("doc_id"))
    drawn = [known.where(F.col(label) == k).orderBy(*order).limit(rows_per_class) for k in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id"
    )
    found = rows.select("doc_id", "text", label).collect()
    return sorted((r[0], bytes(r[1] or b""), int(r[2])) for r in found)


def text_udf(make: Callable[[], Callable[[bytes | None], tuple]], returns: str):
    """Column function over a text column, sent to Python as Arrow batches. `make` runs once per
    task and gives the function that maps one text to the fields of `returns`. A batch is answered
    in pieces, so only a few megabytes of results stand in memory at a time."""
    kind = T._parse_datatype_string(returns)
    arrow = _arrow_struct(kind)

    @F.arrow_udf(kind)
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            rows = [one(value.as_py()) for value in batch]
            fields = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.StructArray.from_arrays(
                [pa.array(list(f), type=a.type) for f, a in zip(fields, arrow)], fields=list(arrow)
            )

    return lambda column: over(column.cast("binary"))


def _arrow_struct(kind: T.StructType) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields]


def logistic(rows, targets, ridge: float = 1e-3, steps: int = 50):
    """Weights of a logistic regression, constant first, by Newton steps on a few columns. Targets
    are drawn in by Platt's correction, so separable classes still give finite weights."""
    import numpy as np

    x = np.column_stack([np.ones(len(rows)), np.asarray(rows, dtype=float)])
    y = np.asarray(targets, dtype=float)
    up, down = y.sum(), len(y) - y.sum()
    y = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    x = x / scale
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights / scale
