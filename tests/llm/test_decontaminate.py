from cases import SENTENCE, SMALL, empty, given, odd

from apexline.llm import decontaminate
from apexline.llm.queries import QUERIES

ITEM = (
    "A train leaves Boston at 40 km an hour and another train leaves Denver at 60 km an hour, so when do they"
    " meet if Boston is 800 km away from Denver"
)


def brute(docs, items):
    """Every item against every document: windows at one distance, slots one to one."""
    tool = decontaminate.Templates()

    def templates(text):
        tokens, kinds, _ = tool.windows(text)
        # Without hashes: what a placeholder or word is, spelled out.
        shape = [k or t.lower() for t, k in zip(tokens, kinds.tolist())]
        return [(tuple(shape[i : i + 8]), [t for t, k in zip(tokens[i : i + 8], kinds[i : i + 8]) if k]) for i in range(len(tokens) - 7)]

    found = set()
    asked = {i: templates(t) for i, t in items}
    for doc, text in docs:
        at = {}
        for k, (shape, slots) in enumerate(templates(text)):
            at.setdefault(shape, []).append((k, slots))
        for item, windows in asked.items():
            lines = {}
            for j, (shape, slots) in enumerate(windows):
                for k, values in at.get(shape, ()):
                    lines.setdefault(k - j, []).append((slots, values))
            need = min(6, len(windows))
            for met in lines.values():
                pairs = {p for a, d in met for p in zip(a, d)}
                even = len(pairs) == len({a for a, _ in pairs}) == len({d for _, d in pairs})
                if len(met) >= need and even or sum(a == d for a, d in met) >= need:
                    found.add((doc, item))
    return found


def test_whole_table(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SMALL).collect()}
    docs, items = given("documents", columns="doc_id, text"), given("benchmark", columns="item_id, text")
    assert got == brute(docs, items)
    assert {(i, k) for i, t in docs for k, x in items if x in t} <= got


def test_asked_anew_with_other_numbers_and_names(spark):
    anew = ITEM.replace("Boston", "Lyon").replace("Denver", "Turin").replace("40", "55").replace("800", "1200.5")
    broken = ITEM.replace("Boston", "Lyon").replace("Denver", "Lyon", 1).replace("60", "40").replace("800", "40")
    docs = [(1, "Before it. " + anew + " and after"), (2, broken), (3, SENTENCE), (4, ITEM), (5, "He said: " + ITEM[:20])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM), (10, SENTENCE[:30])], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 9, False), (4, 9, True)}
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()} == {2, 3, 5}


def test_units_only_after_numbers():
    tool = decontaminate.Templates()
    _, kinds, _ = tool.windows("it took 5 hours and many hours to go 3.5 km by Car")
    assert kinds.tolist() == [0, 0, 1, 3, 0, 0, 0, 0, 0, 1, 3, 0, 2]


def test_odd_rows(spark):
    items = spark.createDataFrame(
        [(1, SENTENCE), (2, None), (None, SENTENCE), (3, ""), (1, SENTENCE), (4, "five short words are here")],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd(spark), items).collect()}
    assert got == {(d, 1) for d in (8, 9, 10, 108, 109, 110, None)}
    kept = decontaminate.decontaminated(odd(spark), items)
    assert kept.columns == odd(spark).columns and kept.filter("doc_id in (8, 9, 10)").count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd(spark), none).count() == 0
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.decontaminated(odd(spark), none).count() == odd(spark).count()


def test_any_case_is_found(spark):
    items = given("benchmark", columns="item_id, text")
    assert len(items) > 2
    docs = []
    for item, text in items:
        for k, shown in enumerate((text, text.upper(), text.lower(), text.title(), text.swapcase())):
            docs.append((10 * item + k, f"{SENTENCE}\n{shown}\n{SENTENCE}"))
    docs.append((-1, f"{SENTENCE} {SENTENCE}"))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert {(10 * i + k, i) for i, _ in items for k in range(5)} <= {(r.doc_id, r.item_id) for r in found.collect()}
    assert found.filter("doc_id = -1").count() == 0


def test_short_items_as_whole_sequences(spark):
    items = [(1, "Name three rivers"), (2, "Why not?"), (3, "What is 4 times 17"), (4, "...")]
    docs = [
        (1, "so NAME Three rivers, please"), (2, "name three other rivers"), (3, "and why not? because"), (4, "WHY NOT"),
        (5, "tell me: what is 4 times 17 ?"), (6, "what is 4 times 18"), (7, ""), (8, None), (9, "...!"),
    ]
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), short=True
    )
    assert {(r.doc_id, r.item_id, r.exact) for r in got.collect()} == {(1, 1, True), (4, 2, True), (5, 3, True)}


def test_documents_are_judged_by_their_own_text(spark):
    half = len(ITEM.split()) // 2
    first, second = " ".join(ITEM.split()[: half - 6]), " ".join(ITEM.split()[half + 6 :])
    docs = spark.createDataFrame(
        [(None, ITEM, "a"), (None, SENTENCE, "b"), (1, ITEM, "c"), (1, SENTENCE, "d"), (0, SENTENCE, "e"),
         (2, first, "f"), (2, second, "g"), (-(1 << 63), SENTENCE, "h"), (-(1 << 63), ITEM, "i"), (3, None, "j")],
        "doc_id long, text string, key string",
    )
    items = spark.createDataFrame([(9, ITEM), (9, "an item of the same id about some other thing than that")], "item_id long, text string")
    alone = {
        r.key for d in ("f", "g")
        for r in decontaminate.decontaminated(docs.filter(f"key = '{d}'"), items).collect()
    }
    kept = {r.key for r in decontaminate.decontaminated(docs, items).collect()}
    assert kept - {"f", "g"} == {"b", "d", "e", "h", "j"} and kept & {"f", "g"} == alone
