"""What of a model is there: artefacts of a folder, and what can be done with them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Names of a model's parts below its folder.
PARTS = {"data": "data", "quantizer": "quantizer", "forest": "forest", "params": "params", "config": "config.json", "predictor": "predictor", "log": "log"}


def scan(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Which parts exist; a model can infer with forest and quantiser, and can be trained with data and quantiser."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for name, part in PARTS.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
        found[name] = bool(at.getFileSystem(conf).exists(at))
    return found | {"can_infer": found["forest"] and found["quantizer"], "can_train": found["data"] and found["quantizer"]}
