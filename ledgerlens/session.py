"""Session helpers.

The library never creates a session behind the caller's back; operators take
DataFrames.  ``build_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the analyses rely on for scale: AQE re-plans joins (broadcast
# only after measuring the side), splits skewed join partitions and coalesces
# small shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is (unset on a cluster is an error, never a machine-local folder).
    Only a local session without the setting (tests) gets a fresh scratch
    folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster "
                               "(scratch tables are written there)")
        d = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 -- core conf not settable at runtime here
            pass
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 -- Spark Connect: the server reads the conf
        pass
    return d


