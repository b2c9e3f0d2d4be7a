"""Page geometry as rows: struck text, lines, ruled tables and headings out of spans, strokes and cells.

Spans: page, line, ord, text, x0, y0, x1, y1, size, bold. Strokes (thin horizontal rules): page, x0, y0, x1, y1. Tables: page,
table_no, x0, y0, x1, y1; their cells as a finder gives them: page, table_no, row_no, x0, x1. Coordinates grow to the right and
down. Strokes meet spans by bands of their height, never all of a page with all. Spans and strokes are shuffled once, by their
page; inside it a band's strokes are a list. A table is worked out inside its row, which has its page's strokes and lines.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

#: Height of a band in which strokes and spans meet.
BAND = 24.0
# Shares and distances of a stroke through a text, of rules that cross a table, and of double borders.
STRUCK_FROM, STRUCK_TO, STRUCK_WIDTH = 0.30, 0.72, 0.6
RULE_GAP, RULE_WIDTH, ROW_GAP, COLUMN_GAP, COLUMN_SHARE, CELL_REST = 1.5, 0.85, 3.0, 4.0, 0.25, 10.0
_EDGES = "array<double>"


def bands(low: Column, high: Column) -> Column:
    """The bands that an interval touches."""
    return F.sequence(F.floor(low / BAND), F.floor(high / BAND))


def with_struck(spans: DataFrame, strokes: DataFrame) -> DataFrame:
    """spans with struck: strokes through the middle of a span's height cover most of its width. A span without width, height
    or visible text never is. Strokes that overlap count each; a repeated span is a span for each row."""
    height, width = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    low, high = F.col("y0") + STRUCK_FROM * height, F.col("y0") + STRUCK_TO * height
    wanted = F.col("page").isNotNull() & (height > 0) & (width > 0) & F.col("text").rlike(r"\S")
    a = spans.select("*", F.when(wanted, low).alias("_lo"), F.when(wanted, high).alias("_hi"), F.lit(True).alias("_is"))
    b = strokes.select("page", F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), "x0", "x1").alias("_k"))
    both = a.unionByName(b, allowMissingColumns=True).repartition("page")
    own = F.when(F.col("_lo").isNotNull(), bands(F.col("_lo"), F.col("_hi"))).otherwise(F.array(F.floor(F.col("_k.y") / BAND)))
    banded = both.withColumn("_band", F.explode(own)).withColumn("_ks", F.collect_list("_k").over(Window.partitionBy("page", "_band"))).where("_is")
    met = F.filter("_ks", lambda k: k["y"].between(F.col("_lo"), F.col("_hi")))
    covered = F.aggregate(met, F.lit(0.0), lambda done, k: done + F.greatest(F.least(F.col("x1"), k["x1"]) - F.greatest(F.col("x0"), k["x0"]), F.lit(0.0)))
    # Equal spans have equal rows in each band: one of them is worked out, and given as often as there are.
    bandwise = banded.withColumn("_c", F.when(F.col("_lo").isNotNull(), covered)).groupBy(*spans.columns, "_band").agg(F.count("*").cast("int").alias("_n"), F.max("_c").alias("_c"))
    whole = bandwise.groupBy(*spans.columns).agg(F.sum("_c").alias("_c"), F.max("_n").alias("_n"))
    struck = F.coalesce(F.when(F.col("_c").isNotNull(), F.col("_c") / width >= STRUCK_WIDTH), F.lit(False)).alias("struck")
    return whole.select(*spans.columns, struck, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy")).drop("_copy")


def lines_of(spans: DataFrame) -> DataFrame:
    """(page, line, text, struck_text, x0, y0, x1, y1, size, bold) of spans with struck: texts in order, without the struck
    ones, which are kept beside; size and bold (nine tenths of its characters) of what is visible. Lines without any text are
    left out."""
    seen = ~F.col("struck") & F.col("text").rlike(r"\S")
    chars = F.length(F.trim("text"))
    placed = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "text")))), lambda s: s["text"]), "")
    rows = spans.groupBy("page", "line").agg(
        squeeze(placed(~F.col("struck"))).alias("text"), squeeze(placed(F.col("struck"))).alias("struck_text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.coalesce(F.max(F.when(seen, F.col("size"))), F.lit(0.0)).alias("size"),
        (F.sum(F.when(seen & F.col("bold"), chars).otherwise(0)) >= 0.9 * F.greatest(F.sum(F.when(seen, chars).otherwise(0)), F.lit(1))).alias("bold"),
    )
    return rows.where("text <> '' or struck_text <> ''")


def _apart(edges: Column, gap: float) -> Column:
    """Edges in order without those that are within gap of the last one kept."""
    empty = F.array().cast(_EDGES)
    return F.aggregate(edges, empty, lambda done, e: F.when((F.size(done) == 0) | (e - F.element_at(done, -1) > gap), F.array_append(done, e)).otherwise(done))


def _bordered(edges: Column, low: Column, high: Column, gap: float) -> Column:
    """Edges with the box's own ones where none is near."""
    first = F.when((F.size(edges) == 0) | (F.get(edges, F.lit(0)) - low > gap), F.concat(F.array(low), edges)).otherwise(edges)
    return F.when(high - F.element_at(first, -1) > gap, F.array_append(first, high)).otherwise(first)


def _often(ends: Column, need: Column) -> Column:
    """Of values in order those that stand there at least `need` times."""
    return F.filter(ends, lambda x, i: F.get(ends, (i + need - 1).cast("int")) == x)


def _ruled(strokes: Column) -> Column:
    """Strokes in order of y with their rule's number: a new one begins where the height is more than a gap below the last."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        rule = F.coalesce(last["rule"], F.lit(0)) + F.coalesce(s["y"] - last["y"] > RULE_GAP, F.lit(False)).cast("int")
        return F.array_append(done, F.struct(rule.alias("rule"), s["a"].alias("a"), s["b"].alias("b"), s["y"].alias("y")))

    return F.aggregate(strokes, F.array().cast("array<struct<rule:int,a:double,b:double,y:double>>"), step)


def _crossing(ruled: Column, width: Column) -> Column:
    """Heights of the rules that cover nearly all of the width, of strokes in order of their rule, a and b."""
    names = ("ys", "rule", "covered", "reach", "sum", "n")
    held = lambda *values: F.struct(*[v.alias(c) for v, c in zip(values, names, strict=True)])
    none = held(F.array().cast(_EDGES), F.lit(-1), F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(0))

    def closed(done: Column) -> Column:
        return F.when((done["n"] > 0) & (done["covered"] >= RULE_WIDTH * width), F.array_append(done["ys"], done["sum"] / done["n"])).otherwise(done["ys"])

    def step(done: Column, s: Column) -> Column:
        more = F.coalesce(F.greatest(s["b"] - F.greatest(s["a"], done["reach"]), F.lit(0.0)), F.lit(0.0))
        reach = F.when(s["b"] > s["a"], F.greatest(done["reach"], s["b"])).otherwise(done["reach"])
        first = held(closed(done), s["rule"], F.greatest(s["b"] - s["a"], F.lit(0.0)), F.when(s["b"] > s["a"], s["b"]), s["y"], F.lit(1))
        return F.when(done["rule"] == s["rule"], held(done["ys"], s["rule"], done["covered"] + more, reach, done["sum"] + s["y"], done["n"] + 1)).otherwise(first)

    return F.aggregate(ruled, none, step, closed)


def _cells(lines: Column, columns: Column) -> Column:
    """Cells (r, c, text) of lines in order of r, c and place, top to bottom: one that reaches the cell's right and does not end
    a sentence goes on with a space, the others with a semicolon."""
    names = ("done", "r", "c", "text", "wrapped")
    held = lambda *values: F.struct(*[v.alias(c) for v, c in zip(values, names, strict=True)])
    none = held(F.array().cast("array<struct<r:int,c:int,text:string>>"), F.lit(0), F.lit(0), F.lit(""), F.lit(False))

    def closed(last: Column) -> Column:
        text = F.trim(last["text"])
        return F.when(text == "", last["done"]).otherwise(F.array_append(last["done"], F.struct(last["r"].alias("r"), last["c"].alias("c"), text.alias("text"))))

    def step(last: Column, s: Column) -> Column:
        wrapped = (s["x1"] >= F.get(columns, s["c"]) - CELL_REST) & ~s["text"].rlike("[.:;]$")
        longer = F.concat(last["text"], F.when(last["wrapped"], " ").otherwise("; "), s["text"])
        same = (last["r"] == s["r"]) & (last["c"] == s["c"])
        return F.when(same, held(last["done"], s["r"], s["c"], longer, wrapped)).otherwise(held(closed(last), s["r"], s["c"], s["text"], wrapped))

    return F.aggregate(lines, none, step, closed)


def gridded(tables: DataFrame) -> DataFrame:
    """table_cells of tables that have in their row what they need: page, table_no, x0, y0, x1, y1, their own cells (row_no, x0,
    x1), and their page's strokes (x0, y0, x1, y1) and lines (text, x0, y0, x1, y1). Nothing is shuffled."""
    low, high, left, right = F.col("y0"), F.col("y1"), F.col("x0"), F.col("x1")
    middle = lambda s, a, b: (s[a] + s[b]) / 2
    row_count = F.size(F.array_distinct(F.array_compact(F.col("cells.row_no"))))
    ends = F.sort_array(F.transform(F.concat("cells.x0", "cells.x1"), lambda x: F.bround(x)))
    near = F.filter("strokes", lambda s: middle(s, "y0", "y1").between(low - 2, high + 2))
    cut = F.transform(near, lambda s: F.struct(middle(s, "y0", "y1").alias("y"), F.greatest(s["x0"], left).alias("a"), F.least(s["x1"], right).alias("b")))
    own = F.filter("lines", lambda s: (s["text"] != "") & middle(s, "x0", "x1").between(left, right) & middle(s, "y0", "y1").between(low, high))
    edged = (
        tables.where("page is not null and table_no is not null")
        .withColumns({"_need": F.greatest(F.lit(2), F.floor(COLUMN_SHARE * row_count)), "_ends": ends, "_ruled": F.sort_array(_ruled(F.sort_array(cut)))})
        .withColumns({"_xs": _apart(_often(F.col("_ends"), F.col("_need")), COLUMN_GAP), "_ys": _apart(_crossing(F.col("_ruled"), right - left), ROW_GAP)})
        .withColumns({"_columns": _bordered(F.col("_xs"), left, right, COLUMN_GAP), "_rows": _bordered(F.col("_ys"), low, high, ROW_GAP)})
        .withColumn("_own", F.transform(own, lambda s: F.struct(middle(s, "x0", "x1").alias("x"), middle(s, "y0", "y1").alias("y"), F.bround(s["y0"]).alias("top"), s["x0"].alias("left"), s["text"].alias("text"), s["x1"].alias("x1"))))
    )
    at = lambda edges, v: F.size(F.filter(edges, lambda e: e <= v))
    placed = F.transform("_own", lambda s: F.struct(at("_rows", s["y"]).alias("r"), at("_columns", s["x"]).alias("c"), s["top"].alias("top"), s["left"].alias("left"), s["text"].alias("text"), s["x1"].alias("x1")))
    inner = F.filter(placed, lambda s: s["r"].between(1, F.size("_rows") - 1) & s["c"].between(1, F.size("_columns") - 1))
    grid = F.when((F.size("_columns") >= 3) & (F.size("_rows") >= 3), _cells(F.sort_array(inner), F.col("_columns")))
    found = edged.select("page", "table_no", grid.alias("_cells")).withColumn("_filled", F.array_distinct("_cells.r"))
    kept = F.when((F.size("_filled") >= 2) & (F.size("_cells") >= 3), F.col("_cells"))
    numbered = F.transform(kept, lambda x: F.struct(F.array_position("_filled", x["r"]).cast("int").alias("row_no"), x["c"].alias("column_no"), x["text"].alias("text")))
    return found.select("page", "table_no", F.inline(numbered))


def table_cells(tables: DataFrame, cells: DataFrame, strokes: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, table_no, row_no, column_no, text) of ruled tables: a grid of column and row edges, each line in the cell that has
    its centre; without empty cells and rows (rows are numbered anew). Tables of fewer than two columns or rows of edges, two
    rows with text or three cells with text are none.

    Column edges: where the cells of a quarter of the rows (two at least) begin or end. Row edges: the rules that cross (nearly)
    a whole table; a rule's segments are the strokes whose heights follow each other within a gap, its width is that of their
    union. All four tables are shuffled once, by their page, which is a row until its tables part."""
    box, edges = ["x0", "y0", "x1", "y1"], ["row_no", "x0", "x1"]
    parts = {"_tables": (tables, ["table_no", *box]), "_cells": (cells, ["table_no", *edges]), "strokes": (strokes, box), "lines": (lines, ["text", *box])}
    rows = [df.where("page is not null").select("page", F.struct(*names).alias(part)) for part, (df, names) in parts.items()]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    pages = both.groupBy("page").agg(*[F.collect_list(part).alias(part) for part in parts])
    parted = pages.select("page", F.explode("_tables").alias("_t"), "_cells", "strokes", "lines")
    own = F.transform(F.filter("_cells", lambda c: c["table_no"] == F.col("_t.table_no")), lambda c: F.struct(*[c[e].alias(e) for e in edges]))
    return gridded(parted.select("page", "_t.*", own.alias("cells"), "strokes", "lines"))


def rendered_tables(cells: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page, table_no, text): tables as blocks of text, a line a row; of the selected pages only, where given."""
    own = cells if pages is None else cells.join(pages.select("page").distinct(), "page", "left_semi")
    listed = own.where("text is not null").groupBy("page", "table_no").agg(F.sort_array(F.collect_list(F.struct("row_no", "column_no", "text"))).alias("_cells"))
    before = lambda x, i: F.when(i == 0, "").when(F.get("_cells", i - 1)["row_no"] == x["row_no"], " | ").otherwise("\n")
    body = F.array_join(F.transform("_cells", lambda x, i: F.concat(before(x, i), x["text"])), "")
    return listed.select("page", "table_no", F.concat(F.lit("[TABLE]\n"), body, F.lit("\n[/TABLE]")).alias("text"))


def is_heading(text: Column, size: Column, bold: Column, body: Column, bullets: tuple[str, ...] = ("•", "-", "–", "*")) -> Column:
    """A line of 3 to 120 characters with a letter, no bullet, no sentence and no list item, that is larger than the body's text
    or bold and short."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    fits = F.length(text).between(3, 120) & ~text.isin(*bullets) & text.rlike("[A-Za-z]") & ~text.rlike("[,;]$") & ~(text.endswith(".") & (words > 8)) & (words <= 16)
    return F.coalesce(fits & ((size >= body * 1.15) | (bold & (words <= 14))), F.lit(False))


def heading_level(text: Column, size: Column, body: Column) -> Column:
    """1 to 4: by the depth of its number, else by its size against the body's."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)[.)]?\s", 1)
    return F.when(number != "", F.least(F.lit(4), F.size(F.split(number, r"\.")))).when(size >= body * 1.6, 1).when(size >= body * 1.3, 2).otherwise(3)
