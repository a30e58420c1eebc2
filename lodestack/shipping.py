"""Sends this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Makes ``import lodestack`` work in every Python worker of the session's cluster.

    The sources are zipped once per Spark context and handed to Spark's own file
    server, which every executor fetches from; where the package is installed on
    the executors anyway, this changes nothing.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_lodestack_shipped", False):
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lodestack-")) / "lodestack_sources.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*")):
                if p.suffix in (".py", ".json") and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(archive))
        sc._lodestack_shipped = True
    return spark
