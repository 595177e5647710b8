"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "caseflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; extra settings win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """The runtime settings the operators count on.

    Results depend on the first alone: every timestamp is read as UTC. The others let a skewed
    join be split even where that costs another shuffle.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir`` for checkpoints and stream output.

    Only a local session may fall back to a temporary folder: on a cluster another machine could
    not read it after an executor is lost.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="caseflow-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
