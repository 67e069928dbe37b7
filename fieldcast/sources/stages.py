"""Intermediate tables: written once, read by all that follows, and kept for a run that goes on later."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local
    mode, and an error on a cluster, whose executors could not read it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-stages-")
    return _own[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its work is done once, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that stored() has written in this application, and says how many. What is still to be computed from them
    can then not be: call it when results are written."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def inputs_digest(*frames: DataFrame, **parameters: object) -> str:
    """A digest of the files that the frames, plain reads of files, consist of (path, size, time of change) and of the parameters."""
    parts = [f"{k}={parameters[k]!r}" for k in sorted(parameters)]
    for df in frames:
        file = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
        each = df.select(*[c.alias(f"c{i}") for i, c in enumerate(file)]).distinct()
        r = each.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c0", "c1", "c2")).alias("h")).first()
        parts.append(f"{r.n}:{r.h}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def stage(spark: SparkSession, run: str, name: str, make: Callable[[], DataFrame], inputs: str = "") -> DataFrame:
    """The table of a stage of a run (a folder): read if an earlier attempt has finished it on these inputs, else made and written.

    A seal beside the table says on which inputs it was finished. It is taken off before the table is written and set
    after, so neither a table that broke off nor one of other inputs is ever read.
    """
    path, sealed = f"{run}/{name}", f"{run}/{name}.seal"
    try:
        seal = spark.read.schema("inputs string").json(sealed).first()
    except AnalysisException:
        seal = None
    if seal is None or seal.inputs != inputs:
        df = make()
        put = lambda x: spark.createDataFrame([(x,)], "inputs string").coalesce(1).write.mode("overwrite").json(sealed)
        if seal is not None:
            put(None)
        df.write.mode("overwrite").parquet(path)
        put(inputs)
    return spark.read.parquet(path)
