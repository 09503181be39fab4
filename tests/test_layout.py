"""Tables from coordinates: laid-out grids with merged and empty cells are read back as they were."""

import random

from lexmill.sources import layout

SPANS = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string"


def laid_out(rng, doc, page, rows, columns):
    """Spans and the cells they come from: one full row, others with missing cells or one cell over two columns."""
    edges, spans, cells = [50.0 + 120 * c for c in range(columns)], [], []
    full = rng.randrange(rows)
    for r in range(rows):
        c = 0
        held = []
        while c < columns:
            width = 1
            if r != full and c + 1 < columns and rng.random() < 0.2:
                width = 2
            if r == full or rng.random() < 0.8:
                held.append((c, width))
            c += width
        if len(held) < 2:
            held = [(c, 1) for c in range(columns)]
        for c, width in held:
            text = f"{doc}.{page}.{r}.{c}"
            x0 = edges[c] + rng.uniform(0, 10)
            x1 = edges[c] + (50 if width == 1 else 120 + rng.uniform(40, 60))
            y0 = 100.0 + 20 * r + rng.uniform(0, 3)
            spans.append((doc, page, x0, y0, x1, y0 + 12, text))
            cells.append((doc, page, 0, r, c, width, text))
    spans += [(doc, page, 40.0, 60.0, 400.0, 72.0, "prose above"), (doc, page, 40.0, 100.0 + 20 * rows + 10, 300.0, 100.0 + 20 * rows + 22, "prose below")]
    return spans, cells


def test_layouts_are_read_back(spark):
    rng = random.Random(4)
    spans, cells = [(9, 1, None, 1.0, 2.0, 3.0, "lost")], []
    for doc in range(12):
        one, want = laid_out(rng, doc, 1 + doc % 2, rng.randint(2, 7), rng.randint(2, 5))
        spans += one
        cells += want
    rng.shuffle(spans)
    got = layout.table_cells(spark.createDataFrame(spans, SPANS).repartition(3)).drop("last_column").collect()
    assert sorted(map(tuple, got)) == sorted(cells) and any(c[5] == 2 for c in cells)


def test_two_tables_of_a_page_and_pages_without(spark):
    grid = lambda y, texts: [(1, 1, 50.0 + 100 * c, float(y), 90.0 + 100 * c, y + 10.0, t) for c, t in enumerate(texts) if t is not None]
    spans = grid(0, ["h", "k"]) + grid(20, ["1", "2"]) + grid(40, ["prose"]) + grid(60, ["a", "b", "c"]) + grid(80, ["d", None, "f"]) + grid(100, ["only"]) + grid(120, ["x", "y"])
    cells = layout.table_cells(spark.createDataFrame(spans, SPANS))
    got = {r.table_no: (r.headers, r.rows) for r in layout.page_tables(cells).collect()}
    assert got == {0: (["h", "k"], [["1", "2"]]), 1: (["a", "b", "c"], [["d", "", "f"]])}
    assert layout.table_cells(spark.createDataFrame(grid(0, ["one"]), SPANS)).count() == 0 and layout.table_cells(spark.createDataFrame([], SPANS)).count() == 0
