from collections import Counter, defaultdict

import pytest
from cases import SMALL, empty, given, odd, odd_rows
from pyspark.sql import functions as F

from apexline.llm import lines
from apexline.llm.queries import QUERIES


def brute(rows):
    """doc_id -> line numbers to remove; every pair of lines is compared."""
    documents = {}
    for doc, text in ((r[0], r[1] or "") for r in rows):
        documents[doc] = text
    order = sorted(documents, key=lambda d: (d is not None, d))
    items = [(d, n, frozenset(s.split())) for d in order for n, s in enumerate(documents[d].split("\n"))]
    items = [(d, n, s) for d, n, s in items if s]
    seen, removed, judged = [], defaultdict(set), {}
    for d, n, s in items:
        if s not in judged:
            judged[s] = any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen)
            hit = judged[s]
            seen.append(s)
        else:
            hit = True
        if hit:
            removed[d].add(n)
    return removed


def reported(df):
    return {(r.doc_id, r.n_lines, tuple(r.removed)) for r in df.collect()}


def wanted(rows):
    removed = brute(rows)
    return {(r[0], len((r[1] or "").split("\n")), tuple(sorted(removed.get(r[0], ())))) for r in rows}


def test_whole_table(spark):
    got = QUERIES["op3_lines"](spark, SMALL).collect()
    want = wanted(given("documents", columns="doc_id, text"))
    assert {(r.doc_id, r.n_lines, tuple(int(n) for n in r.removed.split(",") if n)) for r in got} == want
    assert sum(r.n_removed for r in got) == sum(len(w[2]) for w in want) > 0


@pytest.mark.parametrize("sent", [lines.SENT_LINES, 0])
def test_odd_rows(spark, sent, monkeypatch):
    monkeypatch.setattr(lines, "SENT_LINES", sent)
    assert reported(lines.line_report(odd(spark))) == wanted(odd_rows())
    assert lines.line_report(empty(spark)).count() == 0
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_texts_keep_all_other_columns(spark):
    removed = brute(odd_rows())

    def cut(doc, text):
        if text is None:
            return None
        return "\n".join(s for n, s in enumerate(text.split("\n")) if n not in removed.get(doc, ()))

    got = lines.dedup_lines(odd(spark))
    assert got.columns == odd(spark).columns
    assert Counter(map(tuple, got.collect())) == Counter((r[0], cut(r[0], r[1]), *r[2:]) for r in odd_rows())


@pytest.mark.parametrize("seed", range(2))
def test_crowds_of_alike_lines(spark, seed):
    """Variants of few lines: many pairs share every word of their prefixes."""
    import random

    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        base = words[10 * (k % 3) : 10 * (k % 3) + draw.choice([3, 4, 5, 9, 12, 20])]
        made = [w if draw.random() > 0.08 else draw.choice(words) for w in base]
        rows.append((k, "\n".join([" ".join(made), " ".join(reversed(made)), "one more"])))
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert reported(got) == wanted(rows)


def test_prefix_lengths_leave_no_similar_pair_out(spark):
    sizes = spark.range(1, 200).select(F.col("id").cast("int").alias("n"))
    for n, p in sizes.select("n", lines.probe_length(F.col("n")).alias("p")).collect():
        # A partner shares at least ceil(0.8 n) words.
        assert p == n - -(-4 * n // 5) + 1


def test_main_path_is_native(spark):
    from apexline.llm.common import documents

    plan = lines._sets(documents(spark, SMALL))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_first_pairs_hold_one_that_every_similar_set_has(spark):
    """The pairs asked for are the fewest that hold an unbroken one in the worst case, and no set has fewer pairs."""
    sizes = spark.range(lines.NUM, 200).select(F.col("id").cast("int").alias("n"))
    for n, pairs in sizes.select("n", lines.pair_count(F.col("n")).alias("p")).collect():
        partners = range(-(-4 * n // 5), 5 * n // 4 + 1)
        worst = max(2 * n + b - 3 * -(-4 * (n + b) // 9) for b in partners)
        assert worst < pairs < n


def test_unlike_lines_with_common_words_do_not_meet(spark):
    """Lines that share a rare word each, but no two neighbouring ones: few of them meet."""
    import random

    draw = random.Random(3)
    common = [f"c{k}" for k in range(40)]
    rows = [(k, " ".join([f"rare{k % 5}", *[f"w{draw.randrange(10**9)}" for _ in range(12)], *draw.sample(common, 8)])) for k in range(200)]
    docs = lines._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = lines._sets(docs).select("doc_id", "line_no", "size", "prefix")
    met = lines._meeting(lines._numbered(classes))
    assert met.select("no").distinct().count() < 20
    assert lines.removed_lines(docs).count() == len(brute(rows)) == 0


@pytest.mark.parametrize("most", [lines.MOST_NUMBERS, 0])
def test_numbers_keep_the_order_of_lines(spark, most, monkeypatch):
    monkeypatch.setattr(lines, "MOST_NUMBERS", most)
    rows = [(k, "\n".join(f"line {k} {n}" for n in range(4))) for k in (-(1 << 62), -3, 0, 7, 1 << 40)]
    docs = lines._keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = lines._numbered(lines._exploded(docs).select("doc_id", "line_no")).collect()
    assert sorted(got, key=lambda r: r.no) == sorted(got, key=lambda r: (r.doc_id.id, r.line_no))
    assert len({r.no for r in got}) == 20


def test_runs_weigh_more_than_words_of_their_own_break(spark):
    """Any two similar sets have runs in common that weigh more than _least, wherever they differ, and meet so."""
    import random

    draw = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"x{k}y{n}" for n in range(draw.choice([1, 3, 4, 5, 7, 9, 14, 23, 45]))] + draw.sample([f"c{n}" for n in range(40)], draw.choice([0, 3, 12]))
        gone = draw.randrange(len(base) // 9 + 1)
        rows.append((k, "\n".join([" ".join(base), " ".join(base[gone:] + [f"new{k}n{n}" for n in range(gone)])])))
    docs = lines._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    for rarest in (0, lines.PAIR_CLASS):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lines, "PAIR_CLASS", rarest)
            assert lines.removed_lines(docs).count() == sum(map(len, brute(rows).values())) > 40


def test_lines_that_share_one_pair_of_common_words_do_not_meet(spark):
    """Two words that many lines have side by side are no run; three are asked for."""
    rows = [(k, " ".join([f"a{k // 2}", f"b{k // 2}", *[f"w{n}" for n in range(k % 2, 40, 2)]])) for k in range(3000)]
    docs = lines._keyed(spark.createDataFrame([(k, f"{t} left{k} over{k}") for k, t in rows], "doc_id long, text string"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lines, "PAIR_CLASS", 0)
        met = lines._meeting(lines._numbered(lines._sets(docs)))
        keys = met.groupBy("key").count()
        assert keys.filter("count = 2").count() == 0


def test_bits_differ_in_no_more_than_the_words_do(spark):
    sets = spark.createDataFrame([([3, 9, 300, 70000], [3, 9, 301, 70000, 8]), ([5], [5]), ([], [1 << 30])], "x array<int>, y array<int>")
    for side in "xy":
        bits = [c.alias(f"{side}{n}") for n, c in enumerate(lines._odd_bits(side))]
        sets = sets.select("*", *bits)
    differ = sum(F.bit_count(F.col(f"x{n}").bitwiseXOR(F.col(f"y{n}"))) for n in range(2))
    got = sets.select("x", "y", differ.alias("n")).collect()
    assert all(r.n <= len(set(r.x) ^ set(r.y)) and (r.n > 0) == (r.x != r.y) for r in got)
