import hashlib
import re

from cases import ODD_TEXTS, SMALL, empty, given, odd, odd_rows
from pyspark.sql import functions as F

from apexline.llm import pii
from apexline.llm.common import documents
from apexline.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a@b.c_d@e.f-g.h@i.j x@y z@.q @r.s t%u+v@w-x.yz.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.256.1.1 001.02.3.4 9.9.9 0255.1.2.3 99999999999999999999.1.1.1",
    "4111111111111111 4111-1111 1111-1111 4111  1111 1111 1111 5500 0000 0000 0004 4111111111111112 0000000000000",
    "+1 (017) 555-7713 ++49 30 1234567 +1-2 +123456789012345 +1234567890123456 +1..2()3--4 5 6 7 8 9",
    "é 🙂 me@x.org 🙂🙂 10.1.2.3 ñ +44 20 7946 0958",
    "9" * 3000 + "@" + "a" * 3000 + "." + "b" * 3000,
    ("1 " * 4000) + "+" + "1 " * 4000,
    "a." * 3000 + "@" + "b." * 3000,
]


def good(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if good(kind, m.group())
    ]


def test_whole_table(spark):
    got = QUERIES["op9_pii"](spark, SMALL).collect()
    want = {i: brute(t) for i, t in given("documents", columns="doc_id, text")}
    assert len(got) == len(want) and any(want.values())
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        counts = [sum(s.startswith(k + ":") for s in base) for k in pii.KINDS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(set(spans)) == len(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])))


def test_hard_texts(spark):
    rows = [(k, t) for k, t in enumerate([*HARD, *(t or "" for t in ODD_TEXTS)])]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), None)
    got = {r.doc_id: r.base for r in found.select("doc_id", pii.listed(F.array_sort("base")).alias("base")).collect()}
    assert got == {k: ",".join(brute(t)) for k, t in rows}


def test_odd_rows(spark):
    trees = pii.learn(documents(spark, SMALL))
    got = pii.find(odd(spark), trees)
    assert got.count() == len(odd_rows())
    for r in got.collect():
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert pii.find(empty(spark), trees).count() == 0 and pii.learn(empty(spark)) is None


def test_accepted_candidates_agree_with_the_trees(spark):
    import numpy as np

    trees = pii.learn(documents(spark, "/root/testdata/sf0.01"))
    rows = documents(spark, "/root/testdata/sf0.01").select(F.explode(pii.candidates(F.col("text"))).alias("c"))
    rows = rows.select(F.col("c.features").alias("f"), trees.column(F.col("c.features")).alias("s")).limit(300).collect()
    x = np.array([r.f for r in rows])
    total = trees.start + sum(trees._values(t, x) for t in trees.trees)
    assert np.allclose(1 / (1 + np.exp(-total)), [r.s for r in rows])


def test_main_path_is_native(spark):
    plan = QUERIES["op9_pii"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
