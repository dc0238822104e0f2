"""Line quality: script shares, noise score and reasons of every line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def line_quality(lines: DataFrame, ocr: str) -> DataFrame:
    """lines with arabic_ratio, latin_ratio, printable_ratio, script_consistency, ocr_confidence, noise_score, reasons."""
    s, conf = F.col("text"), F.col(ocr)
    # The measures are one value of a generator's row: what follows reads them and can't make them again.
    parts = lines.withColumn("_m", F.explode(F.array(T.measures(s))))
    parts = parts.select(*lines.columns, "_m.printable_ratio", "_m.script_consistency", F.col("_m.token").alias("_token"), F.col("_m.repeated").alias("_repeated"), F.col("_m.fault").alias("_fault"), conf.alias("ocr_confidence"), "_m.arabic_ratio", "_m.latin_ratio")
    c = F.col
    sum_ = (1 - c("printable_ratio")) * T.NOISE["printable"] + (1 - c("script_consistency")) * T.NOISE["script"] + (1 - c("_token")) * T.NOISE["token"] + c("_repeated") * T.NOISE["repetition"] + F.coalesce((1 - conf) * T.NOISE["ocr"], F.lit(0.0))
    noise = F.when(c("_fault").isNotNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum_)))
    reasons = F.array_compact(
        F.array(
            c("_fault"),
            F.when(c("printable_ratio") < 0.9, "printable"),
            F.when(c("script_consistency") < 0.75, "scripts"),
            F.when(c("_token") < 0.75, "tokens"),
            F.when(c("_repeated") > 0.5, "repetitive"),
            F.when(conf < 0.5, "ocr"),
        )
    )
    return parts.withColumns({"noise_score": noise, "reasons": reasons}).drop("_token", "_repeated", "_fault")
