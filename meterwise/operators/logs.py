"""Log viewer jobs (T5, F8) over many log streams at once.

Each stream (here: one per account) keeps its last N lines; the search runs
over that tail, with the time range measured back from the newest line of
the whole stream. Both the tail and the newest time are per-stream window
results, so a busy stream is cut to N rows per map task before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.config import LOG_RANGES_MINUTES, LOG_TAIL_LINES

ANSI_SGR = r"\x1b\[[0-9;]*m"


def log_tail(lines: DataFrame, n: int = LOG_TAIL_LINES, stream: str = "stream") -> DataFrame:
    """T5: the last ``n`` lines of every stream (line order = id)."""
    w = Window.partitionBy(stream).orderBy(F.desc("id"))
    return lines.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def log_search(lines: DataFrame, levels=("error", "warn", "info", "debug"), time_range: str = "all", query: str = "",
               n: int = LOG_TAIL_LINES, stream: str = "stream") -> DataFrame:
    """F8: filter the tail of each stream by level set, time range and text.

    Lines without a level always pass the level filter; lines without ``at`` always pass
    the range filter; the range is counted back from the newest ``at`` over all lines of
    the stream (not only the tail). The needle is trimmed and lower-cased and searched in
    ``"<timestamp> <source> <message without ANSI codes>"``.
    """
    newest = lines.groupBy(stream).agg(F.max("at").alias("_newest"))
    tail = log_tail(lines, n, stream).join(newest, stream, "left")
    lv = F.col("level")
    out = tail.filter(lv.isNull() | lv.isin(*levels))
    minutes = LOG_RANGES_MINUTES[time_range]
    if minutes is not None:
        oldest = F.col("_newest") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
        out = out.filter(F.col("at").isNull() | F.col("_newest").isNull() | (F.col("at") >= oldest))
    needle = query.strip().lower()
    if needle:
        hay = F.lower(F.concat_ws(" ", F.coalesce("timestamp", F.lit("")), F.coalesce("source", F.lit("")),
                                  F.regexp_replace("message", ANSI_SGR, "")))
        out = out.filter(hay.contains(F.lit(needle)))
    return out.drop("_newest")

