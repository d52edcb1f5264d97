"""An extension beside the one-shot reports: compares consecutive snapshots that arrive in a folder.

Each new file is one snapshot in the stored form (row_index and twelve columns, Parquet).  With ``availableNow`` the
stream ends when all files there are read; a checkpoint location lets it go on later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.report import Analysis, Options, analyze_rows
from ..schema import SNAPSHOT


def watch(spark: SparkSession, folder: str, checkpoint: str, report: Callable[[str | None, str, Analysis], None], options: Options | None = None, pattern: str = "*.parquet") -> StreamingQuery:
    """Calls report(before, after, analysis) for each snapshot file in order of arrival; before is None for the first."""
    last: list[str] = []

    def step(batch: DataFrame, _: int) -> None:
        for r in batch.select("_path").distinct().orderBy("_path").collect():  # the files of this batch: one, by the option below
            path = r["_path"]
            inputs = [*last[-1:], path]
            a = analyze_rows([spark.read.schema(SNAPSHOT).parquet(p) for p in inputs], options or Options())
            report(inputs[0] if len(inputs) == 2 else None, path, a)
            a.release()
            last[:] = [path]

    files = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).option("pathGlobFilter", pattern).parquet(folder)
    return files.withColumn("_path", F.col("_metadata.file_path")).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
