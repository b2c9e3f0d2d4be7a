"""Page geometry against plain loops over a page's spans, strokes and cells."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import layout as L

SPAN = "page long, line int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"
STROKE = "page long, x0 double, y0 double, x1 double, y1 double"


def plain_struck(s, strokes):
    page, _, _, text, x0, y0, x1, y1, *_ = s
    if not text.strip() or x1 <= x0 or y1 <= y0:
        return False
    lo, hi = y0 + 0.30 * (y1 - y0), y0 + 0.72 * (y1 - y0)
    covered = sum(max(0.0, min(x1, b) - max(x0, a)) for p, a, t, b, u in strokes if p == page and lo <= (t + u) / 2 <= hi)
    return covered / (x1 - x0) >= 0.6


def test_struck_spans_and_lines(spark):
    r = random.Random(2)
    spans, strokes = [], []
    for page in range(12):
        for line in range(15):
            for n in range(r.randrange(1, 4)):
                x0, y0 = n * 60.0, line * 12.5
                spans.append((page, line, n, r.choice(["word ", " two  words", " ", "x"]), x0, y0, x0 + r.choice([0.0, 20.0, 50.0]), y0 + 10.0, float(r.choice([8, 12])), r.random() < 0.5))
        for _ in range(25):
            x0, y = r.randrange(0, 150) * 1.0, r.randrange(0, 360) * 0.5
            strokes.append((page, x0, y, x0 + r.randrange(4, 90), y + 1.0))
    spans.append(spans[0])
    got = L.with_struck(spark.createDataFrame(spans, SPAN).repartition(4), spark.createDataFrame(strokes, STROKE))
    rows = [tuple(x) for x in got.collect()]
    assert sorted(rows) == sorted((*s, plain_struck(s, strokes)) for s in spans) and 5 < sum(x[-1] for x in rows) < len(rows) - 5

    want = {}
    for s in sorted(rows, key=lambda s: (s[0], s[1], s[2], s[3])):
        want.setdefault((s[0], s[1]), []).append(s)
    lines = {(x.page, x.line): x for x in L.lines_of(got).collect()}
    for key, own in want.items():
        text, struck = (" ".join("".join(s[3] for s in own if s[-1] == k).split()) for k in (False, True))
        assert (key in lines) == bool(text or struck)
        if key in lines:
            seen = [s for s in own if not s[-1] and s[3].strip()]
            total, bold = sum(len(s[3].strip()) for s in seen), sum(len(s[3].strip()) for s in seen if s[9])
            x = lines[key]
            assert (x.text, x.struck_text, x.size, x.bold) == (text, struck, max((s[8] for s in seen), default=0.0), bool(total) and bold / total >= 0.9)


def merged(values, gap):
    out = []
    for v in sorted(values):
        if not out or v - out[-1] > gap:
            out.append(v)
    return out


def bordered(edges, low, high, gap):
    if not edges or edges[0] - low > gap:
        edges = [low, *edges]
    return edges + [high] if high - edges[-1] > gap else edges


def plain_rows(box, strokes):
    x0, y0, x1, y1 = box
    inside = sorted(((t + u) / 2, max(a, x0), min(b, x1)) for a, t, b, u in strokes if y0 - 2 <= (t + u) / 2 <= y1 + 2)
    groups, last = [], None
    for s in inside:
        if last is None or s[0] - last > 1.5:
            groups.append([])
        groups[-1].append(s)
        last = s[0]
    ys = []
    for g in groups:
        cells = {k for _, a, b in g for k in range(int(a * 2), int(b * 2))}
        if len(cells) / 2 >= 0.85 * (x1 - x0):
            ys.append(sum(s[0] for s in g) / len(g))
    return bordered(merged(ys, 3), y0, y1, 3)


def test_grids(spark):
    r = random.Random(9)
    tables, cells, strokes, lines, want = [], [], [], [], {}
    for page in range(30):
        box = (10.0, 20.0, 210.0, 20.0 + r.randrange(3, 12) * 15)
        tables.append((page, 1, *box))
        xs = sorted({10, 210, *[r.randrange(20, 200) for _ in range(r.randrange(3))]})
        rows = int((box[3] - box[1]) / 15)
        own = []
        for k in range(rows):
            for a, b in zip(xs, xs[1:], strict=False):
                if r.random() < 0.8:
                    cells.append((page, 1, k, a + r.choice([0.0, 0.4, 2.0]), float(b)))
                    own.append(cells[-1])
        drawn = []
        for k in range(rows + 1):
            for _ in range(r.randrange(4)):
                a = float(r.randrange(0, 120))
                drawn.append((a, 20 + 15 * k + r.choice([0.0, 0.5]), a + r.randrange(60, 220), 20.5 + 15 * k))
        strokes += [(page, *s) for s in drawn]
        texts = []
        for k in range(rows * 3):
            x, y = float(r.randrange(5, 200)), 20.0 + r.randrange(rows * 15)
            texts.append((f"t{k}" + r.choice(["", ".", ";"]), x, y, x + r.randrange(4, 60), y + 4.0))
        lines += [(page, *t) for t in texts]
        # The plain way.
        counts = Counter(round(x) for c in own for x in c[3:])
        need = max(2, int(0.25 * len({c[2] for c in own})))
        columns = bordered(merged([float(x) for x, n in counts.items() if n >= need], 4), box[0], box[2], 4)
        edges = plain_rows(box, drawn)
        grid = []
        if own and len(columns) >= 3 and len(edges) >= 3:
            for top, bottom in zip(edges, edges[1:], strict=False):
                values = []
                for left, right in zip(columns, columns[1:], strict=False):
                    inside = [t for t in texts if top <= (t[2] + t[4]) / 2 < bottom and left <= (t[1] + t[3]) / 2 < right and box[0] <= (t[1] + t[3]) / 2 <= box[2] and (t[2] + t[4]) / 2 <= box[3]]
                    inside.sort(key=lambda t: (round(t[2]), t[1], t[0], t[3]))
                    text = ""
                    for i, t in enumerate(inside):
                        if i:
                            p = inside[i - 1]
                            text += " " if p[3] >= right - 10 and not p[0].endswith((".", ":", ";")) else "; "
                        text += t[0]
                    values.append(text)
                if any(values):
                    grid.append(values)
        if len(grid) >= 2 and sum(bool(v) for row in grid for v in row) >= 3:
            want[page] = grid
    box = "page long, table_no int, x0 double, y0 double, x1 double, y1 double"
    found = L.table_cells(
        spark.createDataFrame(tables, box), spark.createDataFrame(cells, "page long, table_no int, row_no int, x0 double, x1 double"),
        spark.createDataFrame(strokes, STROKE), spark.createDataFrame(lines, "page long, text string, x0 double, y0 double, x1 double, y1 double"),
    )
    got = {(x.page, x.row_no, x.column_no): x.text for x in found.collect()}
    assert got == {(p, i + 1, j + 1): v for p, grid in want.items() for i, row in enumerate(grid) for j, v in enumerate(row) if v} and len(want) > 8
    some = spark.createDataFrame([(p,) for p in list(want)[:2]], "page long")
    texts = {x.page: x.text for x in L.rendered_tables(found, some).collect()}
    assert texts == {p: "[TABLE]\n" + "\n".join(" | ".join(v for v in row if v) for row in want[p]) + "\n[/TABLE]" for p in list(want)[:2]}


def test_headings(spark):
    rows = [("2.1 Age limits", 12.0, False, True, 2), ("Plain text", 10.0, False, False, 3), ("Bold text", 10.0, True, True, 3), ("Big", 16.0, False, True, 1), ("Larger", 13.0, False, True, 2), ("•", 20.0, True, False, 1), ("item,", 20.0, True, False, 1), ("ab", 20.0, True, False, 1), ("1.2.3.4.5 deep", 10.0, True, True, 4), (" ".join(["word"] * 9) + ".", 20.0, True, False, 1)]
    table = spark.createDataFrame(rows, "t string, s double, b boolean, want boolean, level int")
    body = F.lit(10.0)
    for x in table.select("*", L.is_heading(F.col("t"), F.col("s"), F.col("b"), body).alias("is"), L.heading_level(F.col("t"), F.col("s"), body).alias("lv")).collect():
        assert (x["is"], x.lv) == (x.want, x.level), x.t


def test_strokes_meet_spans_in_one_shuffle(spark):
    """Spans and strokes are shuffled by their page and never again up to the lines; what lacks a page meets nothing."""
    spans = [(1, 1, 0, "a", 0.0, 0.0, 10.0, 200.0, 8.0, False)] * 3 + [(None, 1, 0, "b", 0.0, 0.0, 10.0, 10.0, 8.0, False), (1, 2, 0, "c", 0.0, 0.0, 0.0, 10.0, 8.0, False)]
    strokes = [(1, 0.0, 69.0, 3.0, 71.0), (1, 3.0, 129.0, 6.0, 131.0), (None, 0.0, 4.0, 10.0, 6.0)]
    found = L.with_struck(spark.createDataFrame(spans, SPAN), spark.createDataFrame(strokes, STROKE))
    plan = L.lines_of(found)._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan ==")].count("Exchange hashpartitioning(") + plan.count("BroadcastExchange") == 1
    assert sorted((x.text, x.struck) for x in found.collect()) == [("a", True)] * 3 + [("b", False), ("c", False)]


def test_grids_are_worked_out_in_their_pages_row(spark, tmp_path):
    """One shuffle by page, from four tables and from an order's lines alike; a page's tables take their own cells, and what lacks
    a page meets nothing. Of selected pages only, the others' lines are not grouped at all."""
    from tessera.plans.layout import rendered_tables

    box = "page long, table_no int, x0 double, y0 double, x1 double, y1 double"
    tables = [(p, t, 0.0, 100.0 * t, 100.0, 100.0 * t + 40.0) for p in (1, None) for t in (1, 2)]
    cells = [(p, t, n, *x) for p in (1, None) for t in (1, 2) for n in range(2) for x in ((0.0, 40.0 + 10 * t), (40.0 + 10 * t, 100.0))]
    strokes = [(p, 0.0, 100.0 * t + 19.5, 100.0, 100.0 * t + 20.5) for p in (1, None) for t in (1, 2)]
    lines = [(p, f"{t}{n}{x}", 10.0 + x, 100.0 * t + 5 + 20 * n, 12.0 + x, 100.0 * t + 15 + 20 * n) for p in (1, None) for t in (1, 2) for n in range(2) for x in (0, 44)]
    lines.append((1, " ", 10.0, 105.0, 12.0, 115.0))
    found = L.table_cells(
        spark.createDataFrame(tables, box), spark.createDataFrame(cells, "page long, table_no int, row_no int, x0 double, x1 double"),
        spark.createDataFrame(strokes, STROKE), spark.createDataFrame(lines, "page long, text string, x0 double, y0 double, x1 double, y1 double"),
    )
    shuffles = lambda df: (p := df._jdf.queryExecution().executedPlan().toString())[: p.find("== Initial Plan ==")].count("Exchange hashpartitioning(") + p.count("BroadcastExchange")
    assert shuffles(found) == 1
    got = {(x.table_no, x.row_no, x.column_no): x.text for x in found.collect()}
    # All lines of the second table stand left of 60, where its columns part: two cells, which are no table.
    assert got == {(1, 1, 1): "; 100", (1, 1, 2): "1044", (1, 2, 1): "110", (1, 2, 2): "1144"}

    spark.sql("select o_orderkey, if(o_orderkey = 1, 'O', 'F') o_orderstatus from values (1L), (2L) t(o_orderkey)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("select k l_orderkey, n l_linenumber, 1L l_partkey, 1L l_suppkey, 1D l_extendedprice, 7D l_quantity, 0.1D l_discount, 'A' l_returnflag, 'F' l_linestatus from values (1L), (2L), (null) a(k), values (1), (2) b(n)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = rendered_tables(spark, str(tmp_path))
    assert shuffles(found) <= 4
    assert [tuple(x) for x in found.collect()] == [(1, 1, "[TABLE]\nAF | 7\nAF | 7.\n[/TABLE]")]
