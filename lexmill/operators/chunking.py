"""Documents to sections to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, ws_tokens


def sections(docs: DataFrame) -> DataFrame:
    """A row for each non-blank line: doc_id, section_pos (from 0), content, chunk_id."""
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_pos", "content"))
        .withColumn("section_pos", F.col("section_pos").cast("long"))
        .filter(~is_blank(F.col("content")))
        .withColumn("chunk_id", F.concat_ws("::", F.col("doc_id"), F.col("section_pos")))
    )


def token_windows(frame: DataFrame, text_col: str = "text", width: int = 512, overlap: int = 50) -> DataFrame:
    """Overlapping windows of white-space tokens; the last may be short, none starts inside the final overlap."""
    step = width - overlap
    n = F.size("tokens")
    count = F.when(n == 0, 0).when(n <= width, 1).otherwise(1 + F.ceil((n - width) / step).cast("int"))
    return (
        frame.withColumn("tokens", ws_tokens(F.col(text_col)))
        .withColumn("windows", count)
        .filter("windows > 0")
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
        .withColumn("chunk", F.slice("tokens", F.col("chunk_no") * step + 1, width))
        .drop("tokens", "windows")
    )


def heading_enriched(path, title, chunk):
    """``## a > b``, a blank line, then the chunk."""
    return F.concat(F.lit("## "), F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), title), F.lit("\n\n"), chunk)


def unique_slugs(frame: DataFrame, doc_col: str, slug_col: str, order_col: str) -> DataFrame:
    """Number repeated slugs of a document -1, -2 and so on in order."""
    from pyspark.sql import Window

    seen = F.row_number().over(Window.partitionBy(doc_col, slug_col).orderBy(order_col)) - 1
    return frame.withColumn("section_id", F.when(seen == 0, F.col(slug_col)).otherwise(F.concat_ws("-", F.col(slug_col), seen)))
