"""Several rows without an id, and several texts of one id, are documents of their own."""

import hashlib
import random
from collections import Counter

import test_lines
import test_suffixes

from apexline.llm import lines, suffixes

SCHEMA = "doc_id long, text string"


def keyed(spark, rows):
    """The distinct (id, text), numbered in the order in which the operators take them, and their numbers."""
    df = spark.createDataFrame(rows, SCHEMA).distinct()
    ordered = df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()
    ordered.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    return {(r.doc_id, r.text): k for k, r in enumerate(ordered)}


def line_rows():
    draw = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    shared = [" ".join(draw.sample(words, 12)) for _ in range(10)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(6):
            line = draw.choice(shared).split() if draw.random() < 0.5 else draw.sample(words, 9)
            if draw.random() < 0.5:
                line = [*line[:-1], f"x{draw.randrange(99)}"]
            parts.append(" ".join(line))
        rows.append((draw.choice([None, None, 3, 3, 100 + k]), "\n".join(parts)))
    return [*rows, rows[0], rows[5]]


def test_lines_of_several_texts(spark):
    rows = line_rows()
    number = keyed(spark, rows)
    removed = test_lines.brute([(number[r], r[1]) for r in rows])

    def want(r):
        return "\n".join(s for n, s in enumerate(r[1].split("\n")) if n not in removed.get(number[r], ()))

    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in lines.dedup_lines(table).collect())
    assert got == Counter((r[0], want(r)) for r in rows)
    listed = Counter((r.doc_id, tuple(r.removed)) for r in lines.line_report(table).collect())
    assert listed == Counter((r[0], tuple(sorted(removed.get(number[r], ())))) for r in rows)


def test_spans_of_several_texts(spark):
    draw = random.Random(2)
    passages = ["".join(draw.choice("abé \n") for _ in range(draw.randint(120, 400))) for _ in range(6)]
    rows = []
    for k in range(40):
        text = "".join(draw.choice(passages)[draw.randint(0, 40) :] for _ in range(draw.randint(1, 8)))
        rows.append((draw.choice([None, None, 3, 3, 100 + k]), text))
    rows += [(None, "short"), (3, ""), rows[0], rows[5]]
    number = keyed(spark, rows)
    want = test_suffixes.brute([(number[r], r[1]) for r in rows])
    got = suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert found == Counter((r[0], *want[number[r]]) for r in rows)
