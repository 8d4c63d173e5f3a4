"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins of two scans are planned by size: a side under the broadcast threshold
# is broadcast, otherwise both sides are shuffled and AQE splits the partitions
# a hot key makes. "force" lets it split even where that costs one more shuffle.
#
# Top-N per parent drops rows before the shuffle for any N a caller may want.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # A table of requests may be large and still cut a table of children to little: both
    # sides are shuffled, the children behind a Bloom filter of the requested keys.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
    # Values of a search for which row groups are skipped one by one, by Bloom filters.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings; sizes and partition counts stay the cluster's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
