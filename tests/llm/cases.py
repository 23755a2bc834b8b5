"""Small tables that hold the awkward cases, and the given tables' rows in Python."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id int, word string, score double, place int"
SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards watch from a quiet hill nearby"
ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "12345 67",
    "日本語のテキスト、混ざった text.",
    "tab\tand\r\nline \x0b ends",
    SENTENCE,
    SENTENCE + " indeed",
    "\n".join([SENTENCE, "Another line here.", SENTENCE, ""]),
    "x" * 5000,
    "word " * 3000,
    "Mail a@b.co_d@e.fr or +1 (017) 555-7713, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.255.",
    "zero\x00byte and a smile 🙂",
]


def odd_rows():
    rows = [(k, t, "en", "s", None, "r", 1, "w", 0.5, 3) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[8], rows[10]]  # repeated rows
    rows += [(100 + k, t, None, None, None, None, None, None, None, None) for k, t in enumerate(ODD_TEXTS)]  # ties
    rows.append((None, SENTENCE, None, None, None, None, None, None, None, None))
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given(table, folder=SMALL, columns="*", order="1"):
    path = f"{folder}/{table}.parquet"
    path = f"{path}/*.parquet" if os.path.isdir(path) else path
    return duckdb.sql(f"select {columns} from '{path}' order by {order}").fetchall()


def pairs(rows):
    """(id, text) with null texts as empty ones."""
    return [(r[0], r[1] or "") for r in rows]
