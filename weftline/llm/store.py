"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one of this machine if Spark runs on it alone (tests); else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _OWN[app]


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage: a lost executor costs tasks, not the stages before, and later readers do not compute
    ``df`` twice. An empty table comes back empty, with its schema.
    """
    path = f"{shared_dir(df.sparkSession)}/weftline/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch that Python gets, at most.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def lean(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches made no larger than ARROW: texts may be long, and a task holds a batch on both sides."""
    conf = df.sparkSession.conf
    for key, most in ARROW.items():
        if conf.isModifiable(key) and not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, str(most))
    return df


_held: dict = {}


def held(name: str, make):  # noqa: ANN001, ANN201
    """In a Python worker: what ``make`` gave for this name before, or gives now. One thing is held at a time.

    Workers go from task to task; an operator's tasks that begin with held("", ...) free what another one's left there.
    """
    if _held.get("name") != name:
        _held.clear()
        _held.update(name=name, value=make())
    return _held["value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sweep(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Delete every table stashed by this driver but those that ``keep`` reads; call it when no other result is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    read = [] if keep is None else keep.inputFiles()
    for path in list(_written):
        if not any(path.rpartition("/")[2] in f for f in read):
            own = jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(conf).delete(own, True)
            _written.remove(path)
