"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the session names; a temporary one only where it names none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="newsflow-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/newsflow/{tag}-{uuid.uuid4().hex[:12]}"


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, sorted; none if there is no such folder. Names that begin with `_` or `.` are left out, but for `_key=` folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n for n in found if not n.startswith((".", "_")) or "=" in n)


def create_once(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Makes a file that must not exist yet, whole or not at all: written under another name first, then renamed. False if it exists."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    begun = hadoop.Path(f"{folder}/_{uuid.uuid4().hex}")
    files = begun.getFileSystem(conf)
    stream = files.create(begun, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = hadoop.FileContext.getFileContext(begun.toUri(), conf)
    try:
        context.rename(begun, hadoop.Path(f"{folder}/{name}"), spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(begun, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True
