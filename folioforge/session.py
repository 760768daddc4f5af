"""Session helpers: shipping the package to executors, shared scratch tables, guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of (compressed) input files whose rows one task takes after an exchange by ``spread``.
PART_BYTES = 2 << 20

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, in local mode only: on a
    cluster each machine would keep its own part of a table."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(_own_dirs[sc.applicationId])
    return _own_dirs[sc.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and a lost executor costs no recompute.

    The tables stay until the folder's owner clears it, as plans that read them may run at any later time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` exchanged by keys, in as many parts as its input files have ``PART_BYTES``, so a task's share stays the same however
    much there is to read. A stated number of parts is not merged again. Rows that come from no files go to the usual number."""
    files = [unquote(f) for f in df.inputFiles()]
    if not files:
        return df.repartition(*keys)
    spark = df.sparkSession
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return df.repartition(max(-(-size // PART_BYTES), spark.sparkContext.defaultParallelism), *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only after counting; larger sides keep the shuffle join that AQE can split."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
