"""Streams of frames: each micro-batch's fields are compressed on their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Config, compress


def compress_stream(stream: DataFrame, cfg: Config, path: str, checkpoint: str, to_field: Callable[[DataFrame, int], DataFrame], once: bool = True) -> StreamingQuery:
    """Writes an archive path/batch=N for each micro-batch.

    to_field makes fields of a batch's rows.  There is no state between frames: a
    bound relative to the range is that of the frame and is stored in its header.
    A batch that is run again replaces its archive.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at = f"{path}/batch={n}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if not batch.isEmpty():
            compress(to_field(batch, n), cfg).write(at)

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
