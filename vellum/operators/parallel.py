"""Task fan-out for Python-heavy stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Session setting: tasks over which scans that feed Python stages are dealt; unset, the scan's own
#: partitions (``spark.sql.files.*``) stand.
SETTING = "spark.vellum.scanPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan over ``spark.vellum.scanPartitions`` tasks, if that is set (say, for
    files of one row group on a machine with many cores). Nothing depends on the input's size."""
    want = df.sparkSession.conf.get(SETTING, None)
    return df.repartition(int(want)) if want else df
