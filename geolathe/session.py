"""Session defaults, the shared folder and materialised tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def build(master: str = "local[8]", app: str = "geolathe", **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_geolathe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="geolathe-")
    path = os.path.join(tmp, "geolathe_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, dirs, files in os.walk(root):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._geolathe_shipped = True
    atexit.register(shutil.rmtree, tmp, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine on a local master; elsewhere an error, as a machine's own folder would lose rows."""
    conf = spark.sparkContext.getConf()
    if d := conf.get("spark.checkpoint.dir", None):
        return d.rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_geolathe_dir", None):
        sc._geolathe_dir = tempfile.mkdtemp(prefix="geolathe-shared-")
        atexit.register(shutil.rmtree, sc._geolathe_dir, True)
    return "file://" + sc._geolathe_dir


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geolathe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._geolathe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing will read again, such as the last round's of a loop."""
    _delete(df.sparkSession, df._geolathe_path)
    _written.remove((df.sparkSession, df._geolathe_path))


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a dense row number from 1 in the given order, without a task that sees all rows: sorted ranges are written, and each is shifted by the rows before it."""
    i, part = "_geolathe_i", "_geolathe_p"
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    s = materialize(s.withColumns({part: F.spark_partition_id(), i: F.monotonically_increasing_id()}), "numbered")
    size = s.groupBy(part).agg(F.count("*").alias("n"), F.min(i).alias("lo"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.join(F.broadcast(size.select(part, "lo", before.alias("before"))), part).withColumn(name, F.col("before") + F.col(i) - F.col("lo") + 1).drop(i, part, "lo", "before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """NaN becomes NULL in the named (else all) double and float columns."""
    pick = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in pick})
