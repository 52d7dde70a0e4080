"""Words of binary files, and tables of words in any order."""

import random

import pandas as pd

from gneiss.sources import layouts


def parse(content: bytes) -> pd.DataFrame:
    """A toy format: a line for each word."""
    if not content.startswith(b"words\n"):
        raise ValueError("no words")
    rows = [x.split("|") for x in content.decode().split("\n")[1:] if x]
    return pd.DataFrame([(int(p), *map(float, at), t) for p, *at, t in rows], columns=["page", "x0", "y0", "x1", "y1", "text"])


def test_words_of_files(spark, tmp_path):
    (tmp_path / "a.bin").write_text("words\n1|0|0|5|5|Hello\n1|6|0|9|5|there\n2|0|0|5|5|\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe no")
    got = layouts.words(spark, f"file://{tmp_path}", parse, "*.bin")
    assert sorted((r.doc.rsplit("/", 1)[1], r.page, r.text) for r in got.collect()) == [("a.bin", 1, "Hello"), ("a.bin", 1, "there"), ("a.bin", 2, "")]
    assert [(r.page, r.line, r.text) for r in layouts.lines(got).collect()] == [(1, 0, "Hello there")]


def test_tables_of_shuffled_words(spark):
    """Random tables, some cells empty, columns of any width: the same cells come back."""
    rng, placed, want = random.Random(2), [], {}
    for doc in range(12):
        y = 0.0
        for table in range(rng.randint(1, 3)):
            n = rng.randint(2, 5)
            left = [20.0 + 120 * c for c in range(n)]
            rows = []
            for r in range(rng.randint(1, 6)):
                row = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 3))) if rng.random() < 0.8 or r == 0 else "" for _ in range(n)]
                if not any(row):
                    row[0] = "x"
                rows.append(row)
                for c, cell in enumerate(row):
                    for k, word in enumerate(cell.split()):
                        placed.append((str(doc), 1, left[c] + 34 * k, y + rng.random(), left[c] + 34 * k + 30, y + 9 + rng.random(), word))
                y += 13
            want[str(doc), table] = rows
            y += 60
    rng.shuffle(placed)
    got = {}
    for r in layouts.open_tables(spark.createDataFrame(placed, layouts.WORDS), between_tables=30).collect():
        got.setdefault((r.doc, r.table), {})[r.row_no] = r.cells
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == want


def test_no_words(spark):
    none = spark.createDataFrame([], layouts.WORDS)
    assert layouts.open_tables(none).isEmpty() and layouts.ruled_tables(none, none.drop("text")).isEmpty() and layouts.lines(none).isEmpty()
