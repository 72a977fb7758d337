"""Pattern scans and replacements over a table of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted


def scan_text(df: DataFrame, text: str, patterns: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Lines matching any named regular expression: ``(keep…, line_number, pattern, hits, content)``.

    Texts without any match are dropped before they are split into lines.
    """
    any_hit = F.lit(False)
    for rx in patterns.values():
        any_hit = any_hit | quoted(text).rlike(rx)
    lines = df.filter(any_hit).select(
        *[quoted(k) for k in keep], F.posexplode(F.split(quoted(text), "\n", -1)).alias("pos", "line"))
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"),
                              F.regexp_count(F.col("line"), F.lit(rx)).cast("long").alias("hits"))
                     for n, rx in patterns.items()])
    return (lines.select(*[quoted(k) for k in keep], (F.col("pos") + 1).alias("line_number"),
                         F.trim("line").alias("content"), F.inline(hits))
            .filter(F.col("hits") > 0))


def replace_text(df: DataFrame, text: str, pattern: str, replacement: str,
                 out: str = "updated") -> DataFrame:
    """Replace a regular expression; adds the new text, the count and a status."""
    n = F.regexp_count(quoted(text), F.lit(pattern)).cast("long")
    new = F.regexp_replace(quoted(text), pattern, replacement)
    status = (F.when(n == 0, "already_canonical").when(new == quoted(text), "no_change")
              .otherwise("updated"))
    return (df.withColumn("status", F.when(quoted(text).isNull(), "missing").otherwise(status))
            .withColumn("replacements", F.when(F.col("status") == "updated", n).otherwise(0).cast("long"))
            .withColumn(out, new))
