"""Personal data by boosted trees over overlapping candidate spans; built-in functions only.

Base spans follow fixed patterns and checks (email, ip, card, phone) and always stay. High-recall
generators propose further spans: written-out or incomplete addresses, digit groups with any
separators, dotted or colon-separated numbers. Boosted trees score a candidate by its format and the
words before it. They are fitted on the driver, from at most `SAMPLE` candidates of about `TEXTS` texts: one that covers a base
span is a positive, the others are negatives, and neither checksums nor the base patterns are features. The
threshold is the lowest score at which PRECISION of the sample's accepted candidates are positives.
Scoring is a column expression made from the trees, so the corpus is read by Spark's functions alone.

Defined cases: null and empty texts have no spans; equal texts have equal spans; of equal candidates
one is kept; long runs of digits or letters are matched without backtracking; extra columns are
ignored; an empty table, or one without candidates, adds no spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive repeats where giving back never helps, and begun only
# where a run begins or the last match ended, so that long runs are read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])[0-9]{1,3}+(?:[.:][0-9]{1,3}+){3,7}+",
    "card": r"(?<![0-9])[0-9]{2,6}+(?:[\x20./-]{0,2}[0-9]{2,6}+){1,8}+",
    "phone": r"(?<![0-9])[+(]{0,2}[0-9]++(?:[\x20()./-]{1,3}[0-9]++){1,6}+",
}
CONTEXT = 24
CONTEXT_WORDS = {
    "says_mail": "mail|contact|write",
    "says_phone": "phone|tel|call|fax|mobile|\\+",
    "says_card": "card|visa|pay|account|iban",
    "says_net": "ip|host|server|addr|net",
}
FEATURES = (
    "kind", "size", "digits", "marks", "blanks", "plus", "letters", "dots", "groups", "longest",
    "joined", "checked", *CONTEXT_WORDS,
)

# Bounds of the training sample: texts, chosen by a hash of the id, and candidates of theirs.
TEXTS = 30_000
SAMPLE = 4096
ROUNDS = 24
DEPTH = 3
RATE = 0.3
PRECISION = 0.98


def _found(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, value>>; positions count code points from 0."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(values)).alias("gap"), values.alias("value"))
    spans = F.aggregate(pairs, start, step, lambda state: state["found"])
    return F.when(F.size(values) > 0, spans).otherwise(empty)


def _gated(kind: str, text: Column, pattern: str) -> Column:
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    if kind == "email":
        gate = F.contains(text, F.lit("@")) | text.contains("at)") | text.contains("at]")
    else:
        gate = text.rlike("[0-9]")
    return F.when(gate, _found(text, pattern)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    each = F.transform(
        F.filter(digits, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    size = F.length(_digits(value))
    if kind == "phone":
        return size.between(9, 15)
    return F.when(size.between(13, 19), _luhn(value)).otherwise(False)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind that match its pattern and pass its check."""
    found = F.filter(_gated(kind, text, BASE[kind]), lambda s: _valid(kind, s["value"]))
    number = F.lit(KINDS.index(kind))
    return F.transform(found, lambda s: F.struct(number.alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _features(text: Column, number: int, span: Column) -> Column:
    value = span["value"]
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))))
    count = lambda pattern: F.length(F.regexp_replace(value, f"[^{pattern}]", ""))
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    made = {
        "kind": F.lit(number),
        "size": F.length(value),
        "digits": count("0-9"),
        "marks": count("./:()-"),
        "blanks": count(" "),
        "plus": F.startswith(value, F.lit("+")).cast("int"),
        "letters": count("A-Za-z"),
        "dots": count("."),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "joined": F.regexp(before, F.lit("[a-z0-9]$")).cast("int"),
        "checked": F.when(count("0-9").between(13, 19), _luhn(value)).otherwise(False).cast("int"),
    }
    for name, words in CONTEXT_WORDS.items():
        made[name] = F.regexp(before, F.lit(words)).cast("int")
    return F.array(*[F.coalesce(made[name].cast("int"), F.lit(0)) for name in FEATURES])


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, features>> of all generators; spans may overlap."""
    def featured(number: int):
        return lambda s: F.struct(
            F.lit(number).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            _features(text, number, s).alias("features"),
        )

    every = [F.transform(_gated(k, text, GENERATORS[k]), featured(n)) for n, k in enumerate(KINDS)]
    return F.concat(*every)


class Trees:
    """Boosted regression trees on the logistic loss, as nested tuples."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees = []
        total = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-total))
            tree = self._grow(x, y - chance, chance * (1 - chance), DEPTH)
            self.trees.append(tree)
            total += self._values(tree, x)
        self.threshold = self._calibrated(1 / (1 + np.exp(-total)), y)

    @staticmethod
    def _leaf(g: np.ndarray, h: np.ndarray) -> float:
        return round(float(RATE * g.sum() / (h.sum() + 1)), 6)

    def _grow(self, x, g, h, depth):
        if depth == 0 or len(g) < 8:
            return self._leaf(g, h)
        best = (1e-6, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in values[:-1] if len(values) <= 32 else np.unique(np.quantile(values, np.linspace(0, 1, 33)[1:-1]).astype(int)):
                low = x[:, f] <= cut
                a, b = g[low], g[~low]
                if not len(a) or not len(b):
                    continue
                gain = a.sum() ** 2 / (h[low].sum() + 1) + b.sum() ** 2 / (h[~low].sum() + 1) - whole
                if gain > best[0]:
                    best = (gain, f, int(cut))
        _, f, cut = best
        if f is None:
            return self._leaf(g, h)
        low = x[:, f] <= cut
        return f, cut, self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)

    def _values(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._values(low, x), self._values(high, x))

    @staticmethod
    def _calibrated(scores: np.ndarray, y: np.ndarray) -> float:
        for at in np.unique(scores):
            if y[scores >= at].mean() >= PRECISION:
                return float(at) - 1e-9
        return 2.0

    def column(self, features: Column) -> Column:
        """The score as a column over the features array."""

        def walk(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(features[f] <= cut, walk(low)).otherwise(walk(high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + walk(tree)
        return 1 / (1 + F.exp(-total))


def _covers_base(candidate: Column, base: Column) -> Column:
    return F.exists(
        base,
        lambda b: (b["kind"] == candidate["kind"]) & (candidate["start"] <= b["start"]) & (b["end"] <= candidate["end"]),
    )


def _inside_base(candidate: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] <= candidate["start"]) & (candidate["end"] <= b["end"]))


def _with_spans(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans(text, k).alias(k) for k in KINDS])
    return rows.select("doc_id", "text", *KINDS, F.concat(*KINDS).alias("base"))


def learn(docs: DataFrame) -> Trees | None:
    """Fit the trees on at most SAMPLE candidates of about TEXTS texts."""
    share = TEXTS / max(1, docs.count())
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = _with_spans(docs.filter(drawn < share))
    rows = rows.filter(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"))
    rows = rows.select(F.xxhash64("text").alias("seed"), "base", F.explode(candidates(F.col("text"))).alias("c"))
    rows = rows.select(
        F.xxhash64("seed", "c.kind", "c.start", "c.end").alias("draw"),
        "c.features",
        _covers_base(F.col("c"), F.col("base")).cast("int").alias("y"),
    )
    taken = rows.orderBy("draw", "y", "features").limit(SAMPLE).collect()
    y = np.array([r["y"] for r in taken])
    if not len(y) or y.min() == y.max():
        return None
    return Trees(np.array([r["features"] for r in taken]), y)


def find(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, text, one array of base spans per kind, and spans: base and accepted candidates.

    A span is struct<kind, start, end>, kind being its place in KINDS; arrays are in that order.
    """
    rows = _with_spans(docs)
    if trees is None:
        spans = F.col("base")
    else:
        accepted = F.filter(candidates(F.col("text")), lambda c: trees.column(c["features"]) >= trees.threshold)
        accepted = F.filter(accepted, lambda c: ~_inside_base(c, F.col("base")))
        plain = F.transform(accepted, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
        spans = F.array_union(F.col("base"), plain)
    return rows.select("doc_id", "text", *KINDS, "base", F.array_sort(spans).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
