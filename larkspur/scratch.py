"""A fresh folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir, on Hadoop's default file system if the setting names none. Where it is unset, a new temporary
    folder serves a local master, as in tests; on a cluster, where executors would not share it, that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.replace('file:/', 'file:///', 1) if root.startswith('file:/') and not root.startswith('file://') else root}/larkspur-{uuid.uuid4().hex}"
