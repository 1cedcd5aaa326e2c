"""Stage tables of a run: written once, reread unless forced or made of other inputs or parameters."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Folders of applications that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary one for the application, in local mode
    only: executors elsewhere wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="phaseframe-")
            atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
        folder = "file://" + _own[application]
    return folder.rstrip("/")


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Of the files that these paths or patterns name: changes with their names, sizes and times."""
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for top in system.globStatus(p) or []:
            for f in system.listStatus(top.getPath()) if top.isDirectory() else [top]:
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return key_of(*sorted(found))


def key_of(*facts: object) -> str:
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()


def stage(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], force: bool = False, key: str = "") -> DataFrame:
    """The table ``name``, made and written if it isn't there completely or ``force`` is set.

    ``key`` stands for what the rows depend on, parameters and inputs: a table made with another one is not
    read. A table is complete once its writer has committed all tasks, so an interrupted run leaves none.
    """
    path = f"{folder}/{name}" + (f"-{key[:20]}" if key else "")
    if force or not _complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the interpreter ends."""
    path = f"{shared_folder(spark)}/phaseframe-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read back: what
    several later steps read is computed once, and plans stay small. Tables go when the interpreter ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass
