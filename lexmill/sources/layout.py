"""Tables out of the coordinates of text spans: rows by gaps between lines, columns by the rows that have most cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of its height by which a span may overlap the line above it.
OVERLAP = 0.3
PAGE = ["doc_id", "page"]


def lines(spans: DataFrame) -> DataFrame:
    """``spans(doc_id, page, x0, y0, x1, y1, text)`` with ``line``, from 0 down the page, and ``n``, the spans of that line.

    A line ends where the next span starts below all that came before it.
    """
    above = F.max("y1").over(Window.partitionBy(*PAGE).orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, -1))
    begins = above.isNull() | (F.col("y0") >= above - OVERLAP * (F.col("y1") - F.col("y0")))
    so_far = Window.partitionBy(*PAGE).orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)
    numbered = spans.withColumn("begins", begins.cast("long")).withColumn("line", F.sum("begins").over(so_far) - 1).drop("begins")
    return numbered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "line")))


def table_cells(spans: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, row, column, width, text) of the tables on each page.

    Two lines or more of two spans or more that follow each other are a table. Its columns are those of the lines with
    most spans; a span starts in the column in which its left edge lies, and is ``width`` columns wide, so cells that are
    merged or missing do not shift others. Spans without coordinates are left out; a page without tables has no rows.
    """
    known = spans.filter(" and ".join(f"{c} is not null" for c in ("x0", "y0", "x1", "y1")))
    found = lines(known)
    each = found.select(*PAGE, "line", "n").distinct()
    down = Window.partitionBy(*PAGE).orderBy("line")
    starts = (F.col("n") > 1) & (F.coalesce(F.lag("n").over(down), F.lit(0)) < 2)
    tabled = each.withColumn("table_no", F.sum(starts.cast("long")).over(down) - 1).filter("n > 1")
    whole = Window.partitionBy(*PAGE, "table_no")
    tabled = tabled.withColumns({"lines": F.count(F.lit(1)).over(whole), "most": F.max("n").over(whole), "top": F.min("line").over(whole)}).filter("lines > 1")
    tabled = tabled.withColumn("table_no", F.dense_rank().over(down.orderBy("table_no")) - 1)
    cells = found.join(tabled.select(*PAGE, "line", "table_no", "most", "top"), [*PAGE, "line"])
    table = [*PAGE, "table_no"]
    nth = F.row_number().over(Window.partitionBy(*table, "line").orderBy("x0", "x1"))
    columns = cells.filter("n = most").withColumn("k", nth).groupBy(*table, "k").agg(F.min("x0").alias("low"), F.max("x1").alias("high"))
    between = (F.col("high") + F.lead("low").over(Window.partitionBy(*table).orderBy("k"))) / 2
    bounds = columns.withColumn("b", between).groupBy(*table).agg(F.array_sort(F.collect_list("b")).alias("bounds"))  # a bound a column
    placed = cells.join(bounds, table)
    first = F.size(F.filter("bounds", lambda b: b <= F.col("x0")))
    last = F.size(F.filter("bounds", lambda b: b < F.col("x1")))
    return placed.select(*table, (F.col("line") - F.col("top")).alias("row"), first.alias("column"), F.greatest(last - first + 1, F.lit(1)).alias("width"), "text", F.size("bounds").alias("last_column"))


def page_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, headers, rows) of ``table_cells``: missing cells are empty, merged ones stand in their first column."""
    by = [*PAGE, "table_no"]
    held = cells.groupBy(*by, "row", "last_column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.coalesce("text", F.lit("")).alias("text"))))).alias("at"))
    line = F.transform(F.sequence(F.lit(0), F.col("last_column")), lambda c: F.coalesce(F.try_element_at("at", c), F.lit("")))
    lines_ = held.select(*by, F.struct("row", line.alias("cells")).alias("r")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("all"))
    return lines_.select(*by, F.get("all", F.lit(0)).alias("headers"), F.slice("all", 2, F.size("all")).alias("rows"))
