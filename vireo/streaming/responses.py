"""The response-validation job on a stream of JSON-lines files.

The batch operators are stateless per row, so the same plan runs under
Structured Streaming: text files arriving in ``source`` are parsed and
validated, accepted responses are projected and appended to ``sink`` as JSON
lines, with progress in a checkpoint folder that the caller names
(restart-safe, exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import responses as RP


def validated_stream(spark: SparkSession, source: str, signature_dim: int = RP.SIGNATURE_DIM,
                     color_dim: int = RP.COLOR_DIM, rules: str = "full",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(source).withColumnRenamed("value", "payload")
    return RP.validate(lines, "payload", signature_dim, color_dim, rules)


def validate_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                    available_now: bool = False, **kw):
    """Start the stream; returns the ``StreamingQuery``. ``checkpoint`` names the
    progress folder: a restart with the same one goes on where the last run ended."""
    v = validated_stream(spark, source, **kw)
    out = RP.project_full(v)
    w = out.writeStream.format("json").option("path", sink) \
        .option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.outputMode("append").start()


def reason_counts(spark: SparkSession, source: str, **kw) -> DataFrame:
    """Running count per outcome (stateful aggregate; use complete/update mode)."""
    v = validated_stream(spark, source, **kw)
    return v.groupBy(F.coalesce(F.col("reason"), F.lit("ok")).alias("outcome")).count()
