"""Text to lines, one packet each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_lines(df: DataFrame, text: str = "text", lstrip: bool = True, rstrip: bool = True, strip_comments: bool = True, strip_blank: bool = True, add_nul: bool = False, add_new_line: bool = False, limit: int | None = None, forward_truncated: bool = False) -> DataFrame:
    """A row for each line, numbered in its text from 0 by ``line_no`` before any is dropped. White space is space and 0x09-0x0D; ``rstrip`` never takes the last character left.
    A line of more than ``limit`` characters is left out, or with ``forward_truncated`` cut, before it is stripped. ``add_new_line`` and ``add_nul`` append, in this order."""
    keep = [c for c in df.columns if c != text]
    line = F.col("line")
    d = df.where(F.length(text) > 0).select(*keep, F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("line_no", "line"))
    if limit is not None:
        d = d.withColumn("truncated", F.length("line") > limit)
        d = d.withColumn("line", F.substring("line", 1, limit)) if forward_truncated else d.where("NOT truncated").drop("truncated")
    if lstrip:
        line = F.regexp_replace(line, r"^[ \t-\r]+", "")
    if rstrip:
        line = F.regexp_replace(line, r"(?s)(?<=.)[ \t-\r]+$", "")
    d = d.withColumn("line", line)
    if strip_comments:
        d = d.where(~F.startswith("line", F.lit("#")))
    if strip_blank:
        d = d.where(F.length("line") > 0)
    end = "\n" * add_new_line + "\0" * add_nul
    return d.withColumn("line", F.concat("line", F.lit(end))) if end else d
