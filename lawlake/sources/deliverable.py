"""A deliverable: partitioned files with a manifest of names, sizes and checksums, published by one rename.

Defined results: an empty table gives a manifest without files; a deliverable that exists is never overwritten.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawlake import session


def write(df: DataFrame, folder: str, name: str, fmt: str = "parquet", by: list[str] | None = None) -> dict:
    """Writes a table beside its manifest; returns the manifest."""
    spark, staging = df.sparkSession, f"{folder}/.{name}.staging"
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(f"{staging}/data")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{staging}/data")
    listed = files.select(F.regexp_extract("path", r"/data/(.*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where("name NOT LIKE '%_SUCCESS'")
    manifest = {"name": name, "format": fmt, "rows": df.count(), "columns": df.columns, "files": [r.asDict() for r in listed.orderBy("name").toLocalIterator()]}
    session.create_text(spark, f"{staging}/manifest.json", json.dumps(manifest, ensure_ascii=False))
    session.rename(spark, staging, f"{folder}/{name}")
    return manifest
