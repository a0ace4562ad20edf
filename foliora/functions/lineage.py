"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from foliora.errors import ConfigurationError


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a temporary one is made if all
    tasks run in this very process (master ``local``, as in tests); on a cluster, whose machines wouldn't
    share it, that is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc._jsc.sc().isLocal():
                raise ConfigurationError("spark.checkpoint.dir is unset: name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="foliora-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
