"""Line deduplication by an exact set-similarity join; built-in functions only.

A line is its set of words. A line is removed if an earlier line (by doc_id, then line number) has a
set with a Jaccard similarity of at least 0.8, whether or not that earlier line is itself removed.

1. Words are counted over the whole corpus in 2 ** TABLE_BITS buckets of their hash. A word's rarity is
   the class of its bucket's count, which any row can look up without a join. Lines become arrays of
   numbers, rarest word first.
2. Equal lines are one class, standing where its first line stands. Copies end before their words are looked at. A class has a number that
   keeps this order.
3. Classes meet on runs of words that are neighbours in their order, under the length filter: two words from a rare
   word on, three from others. A word of its own breaks at most two pairs or three runs of three of its set, and
   one or two of the other's; so where a pair weighs 3 and a run of three 2, u and v words of their own break 6u + 4v,
   and the first runs that weigh more hold one of both. Neighbouring rare words are shared by far fewer sets than
   one is. Runs that one class alone has end here.
4. Of the pairs of classes that meet, those stay whose common runs weigh as much as those of similar sets do, and whose
   words' bits do not differ too much; they are verified on the words themselves. Each class is first verified against one
   earlier class, the first of those with the same runs; only classes that this does not remove meet the others, the
   likeliest first. So a large group of alike lines is verified by about one pair a line.

Defined cases: null text is empty; lines without a word are always kept; words are separated by white
space and compared as they are; rows with the same doc_id and text are taken as the same document, so
repeated rows are treated alike and do not remove each other; rows of one doc_id, or without one, that differ in
their texts are documents of their own, in the order of a hash of the text; a null doc_id comes before all others;
extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from apexline.functions.session import cut, fresh_dir
from apexline.llm.common import MISSING, as_rows, repeated_ids, whole_text, with_keys

# Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
TABLE_BITS = 17
# Numbers of needed lines are sent to every executor up to this many, and shuffled beyond.
SENT_LINES = 2_000_000
# Classes are numbered by arithmetic on id and line number below this, and by sorting beyond.
MOST_NUMBERS = 1 << 62
# Words of buckets up to this class are rare: runs that begin with one are pairs, others have three words.
PAIR_CLASS = 40
# Ends the words of a set; no word's number is larger.
END = (1 << 31) - 1
# White space but the blank; lines have no line breaks.
OTHER_SPACE = "[\t\r\x0b\f]"


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = fresh_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _up(value: Column, num: int, den: int) -> Column:
    """value * num / den, rounded up, in whole numbers."""
    return ((value * num + (den - 1)) / F.lit(den)).cast("int")


def probe_length(size: Column) -> Column:
    return size - _up(size, NUM, DEN) + 1


def pair_count(size: Column) -> Column:
    """As many pairs of neighbours, from the rarest word on, hold one that a similar set has too.

    Sets of a and b words with c in common, 9 c >= 4 (a + b), have u = a - c and v = b - c of their own: 2u + v is
    (2a - b) / 3 at most, for the least b, and probe_length is a - b + 1 for that b.
    """
    return ((size + probe_length(size) - 1) / F.lit(3)).cast("int") + 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, from here on the key of (doc_id, text), and text; what is keyed stays as it is."""
    if isinstance(docs.schema["doc_id"].dataType, StructType):
        return docs
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    return with_keys(rows, F.col("text"), repeated_ids(docs)).select(F.col("key").alias("doc_id"), "text")


def _exploded(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line and a 128-bit name of the line's text, for lines that have a word."""
    rows = _keyed(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(r"\S")).select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("name_a"), F.xxhash64(F.lit(1), "line").alias("name_b")
    )


def _words(line: Column) -> Column:
    """Words of a line, with empty ones; the blank is by far the most common separator, and cheap to split on."""
    blank = F.when(line.rlike(OTHER_SPACE), F.regexp_replace(line, OTHER_SPACE, " ")).otherwise(line)
    return F.split(blank, " ")


def rarity_classes(docs: DataFrame) -> str:
    """A JSON list: for each bucket of word hashes the class of its count, from 0 to 127."""
    blank = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    # Other white space is rare, and the order of words needs no exact counts.
    words = _keyed(docs).select(F.explode(F.split(blank, " ")).alias("word"))
    bucket = F.xxhash64("word").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int")
    counts = words.groupBy(bucket.alias("bucket")).count().toArrow()
    classes = ["0"] * (1 << TABLE_BITS)
    for at, n in zip(counts.column(0).to_pylist(), counts.column(1).to_pylist()):
        classes[at] = str(min(127, int(4 * math.log2(1 + n))))
    return f"[{','.join(classes)}]"


def _budget(size: Column) -> Column:
    """Six for each word of its own and four for each of a similar set's own add up to this at most.

    Sets of a and b words with at least 4 (a + b) / 9 in common have 6 u + 4 v <= (14 a - 4 b) / 9 (see _least), which
    is most for the least b, 4 a / 5.
    """
    return size + probe_length(size) - 1


def _odd_bits(words: str) -> list[Column]:
    """odd_a and odd_b: of 128 bits of the words' numbers, those that an odd number of words has.

    Words that two sets share do not count, so that the sets differ in at least as many words as in these bits.
    """

    def odd(half: int) -> Column:
        def flip(bits: Column, w: Column) -> Column:
            one = w.bitwiseAND(1) if half else F.bitwise_not(w).bitwiseAND(1)
            return bits.bitwiseXOR(F.call_function("shiftleft", one.cast("long"), F.shiftright(w, 1)))

        return F.aggregate(words, F.lit(0).cast("long"), flip)

    return [odd(0).alias("odd_a"), odd(1).alias("odd_b")]


def _sets(docs: DataFrame, copied: DataFrame | None = None) -> DataFrame:
    """Each line's place and name, its word set's size and its rarest words' numbers, as many as its runs need.

    copied: name_a, name_b, at; the names that several lines have, and the first one's place. The later ones are
    marked as copy, and their words are not looked at; many is set for all of them.
    """
    classes = F.from_json(F.lit(rarity_classes(docs)), "array<tinyint>")
    low = F.lit((1 << TABLE_BITS) - 1).cast("long")

    def number(h: Column) -> Column:
        """The class in the top byte; never null, so that arrays of numbers are plain."""
        rarity = F.coalesce(F.get(classes, h.bitwiseAND(low).cast("int")), F.lit(0).cast("byte")).cast("int")
        return F.call_function("shiftleft", rarity, F.lit(24)).bitwiseOR(F.shiftrightunsigned(h, 40).cast("int"))

    rows = _exploded(docs)
    if copied is None:
        rows = rows.withColumns({"many": F.lit(False), "copy": F.lit(False)})
    else:
        place = F.struct("doc_id", "line_no")
        rows = rows.join(_few(copied), ["name_a", "name_b"], "left")
        rows = rows.withColumns({"many": F.col("at").isNotNull(), "copy": F.coalesce(F.col("at") != place, F.lit(False))})
    line = F.when(F.col("copy"), "").otherwise(F.col("line"))
    rows = rows.withColumn("hashes", F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))))
    # Few lines have an empty word, and taking it out is dear.
    none = F.xxhash64(F.lit(""))
    hashes = F.when(F.array_contains("hashes", none), F.array_remove("hashes", none)).otherwise(F.col("hashes"))
    place = ["doc_id", "line_no", "name_a", "name_b", "many", "copy"]
    rows = rows.select(*place, F.sort_array(F.transform(hashes, number)).alias("words"))
    size = F.size("words")
    # As many as the longest runs need; two more words end the last one.
    most = (_budget(size) / F.lit(2)).cast("int") + 3
    ended = F.when(size < most, F.concat("words", F.array(F.lit(END), F.lit(END)))).otherwise(F.col("words"))
    return rows.select(*place, size.alias("size"), F.slice(ended, 1, most).alias("prefix"), *_odd_bits("words"))


def _similar(common: Column, a: Column, b: Column) -> Column:
    return common * (NUM + DEN) >= (a + b) * NUM


def _numbered(classes: DataFrame) -> DataFrame:
    """The classes, each with a number, no; an earlier line's is smaller."""
    told = F.coalesce(F.max((F.col("doc_id.a") != 0) | (F.col("doc_id.b") != 0)), F.lit(False))
    least, most = F.coalesce(F.min("doc_id.id"), F.lit(0)), F.coalesce(F.max("doc_id.id"), F.lit(0))
    least, most, last, told = classes.select(least, most, F.coalesce(F.max("line_no"), F.lit(0)), told).first()
    if not told and (most - least + 1) * (last + 1) <= MOST_NUMBERS:
        return classes.withColumn("no", (F.col("doc_id.id") - F.lit(least)) * F.lit(last + 1).cast("long") + F.col("line_no"))
    # The numbers of a sorted table's rows grow from one partition to the next.
    ordered = classes.orderBy("doc_id", "line_no").withColumn("no", F.monotonically_increasing_id())
    return _stored(ordered, "line-numbers")


def _few(df: DataFrame) -> DataFrame:
    """df, sent to every executor if it has few rows."""
    return F.broadcast(df) if df.count() <= SENT_LINES else df


def _meeting(classes: DataFrame) -> DataFrame:
    """key, no, size, head: the runs of neighbours that several classes have, and the first class that has them."""
    rare = F.size(F.filter("prefix", lambda w: w < ((PAIR_CLASS + 1) << 24)))
    budget = _budget(F.col("size"))
    # A run is taken if what is before it weighs no more than the budget.
    runs = F.when(rare * 3 > budget, pair_count(F.col("size")))
    runs = runs.otherwise(rare + ((budget - rare * 3) / F.lit(2)).cast("int") + 1)
    rows = classes.select("no", "size", "prefix", runs.alias("runs"))
    rows = rows.select("no", "size", "prefix", "runs", F.posexplode("prefix").alias("at", "word")).filter("at < runs")
    second, third = (F.get("prefix", F.col("at") + k) for k in (1, 2))
    # The last bit tells a pair.
    pair = F.xxhash64("word", second).bitwiseOR(F.lit(1).cast("long"))
    three = F.xxhash64("word", second, third).bitwiseAND(F.lit(-2).cast("long"))
    key = F.when(F.col("word") < ((PAIR_CLASS + 1) << 24), pair).otherwise(three)
    rows = rows.select("no", "size", key.alias("key"))
    group = Window.partitionBy("key")
    rows = rows.select("key", "no", "size", F.min("no").over(group).alias("head"), F.max("no").over(group).alias("last"))
    # As Parquet, which is compressed.
    return _stored(rows.filter("head < last").select("key", "no", "size", "head"), "line-meetings")


def _least(a: Column, b: Column) -> Column:
    """The runs that similar sets of a and b words both have weigh more than this, of those taken for both.

    What is before a common run in the first set is broken, and weighs (14 a - 4 b) / 9 at most, or common too. So a
    common run is taken for both sets as long as the common ones before it weigh no more than both budgets leave.
    """
    left = lambda x, y: _budget(x) - ((x * 14 - y * 4) / F.lit(9)).cast("int")
    return F.least(left(a, b), left(b, a))


def _lines(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """no, line of the classes in pairs (later, earlier)."""
    needed = cut(pairs.select(F.explode(F.array("later", "earlier")).alias("no")).distinct())
    places = classes.join(_few(needed), "no", "left_semi")
    places = cut(places.select("no", F.col("doc_id").alias("need_doc"), F.col("line_no").alias("need_line")))
    rows = _keyed(docs).join(_few(cut(places.select("need_doc").distinct())), F.col("doc_id") == F.col("need_doc"), "left_semi")
    rows = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.join(_few(places), (F.col("doc_id") == F.col("need_doc")) & (F.col("line_no") == F.col("need_line")))
    # Rows of the same doc_id and text have the same lines.
    return _stored(rows.select("no", "line").dropDuplicates(["no"]), "lines-compared")


def _verified(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (later, earlier), the later numbers of those whose words are similar, once each."""
    met = pairs.select("later", "earlier")
    for name in ("later", "earlier"):
        met = met.join(lines.withColumnsRenamed({"no": name, "line": f"{name}_line"}), name)
    # In one expression each, and kept without the words: lines are dear to split, and checkpoints are not compressed.
    sets = [F.array_remove(F.array_distinct(_words(F.col(f"{name}_line"))), "") for name in ("later", "earlier")]
    common = F.size(F.array_intersect(*sets))
    met = cut(met.select("later", common.alias("common"), *[F.size(x).alias(n) for x, n in zip(sets, "ab")]))
    return cut(met.filter(_similar(F.col("common"), F.col("a"), F.col("b"))).select(F.col("later").alias("no")).distinct())


def _near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """no of the classes that an earlier class is similar to."""
    met = _meeting(classes)
    # One earlier class for each: the first one with the same runs, by most such runs, if these are many.
    starts = met.filter("head < no").groupBy("no", "head").agg(F.count("*").alias("count"), F.min("size").alias("size"))
    starts = starts.filter(F.col("count") >= probe_length(F.col("size")))
    starts = starts.groupBy("no").agg(F.max(F.struct("count", "head")).alias("best"))
    starts = cut(starts.select(F.col("no").alias("later"), F.col("best.head").alias("earlier")))
    removed = _verified(_lines(docs, classes, starts), starts)
    a, b = F.col("x.size"), F.col("y.size")
    fits = (b * DEN >= a * NUM) & (a * DEN >= b * NUM)
    met = _stored(met.join(classes.select("no", "odd_a", "odd_b"), "no"), "line-bits")
    differ = sum(F.bit_count(F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}"))) for n in ("odd_a", "odd_b"))
    fits &= differ <= a + b - _up(a + b, NUM, NUM + DEN) * 2
    left = met.filter("head < no").join(_few(removed), "no", "left_anti").alias("x")
    pairs = left.join(met.alias("y"), (F.col("x.key") == F.col("y.key")) & fits & (F.col("y.no") < F.col("x.no")))
    weight = F.lit(2) + F.col("x.key").bitwiseAND(F.lit(1).cast("long"))
    pairs = pairs.groupBy(F.col("x.no").alias("later"), F.col("y.no").alias("earlier")).agg(
        F.sum(weight).alias("weight"), F.min(_least(a, b)).alias("least")
    )
    # What is compared already is left out.
    pairs = cut(pairs.filter("weight > least").join(starts, ["later", "earlier"], "left_anti"))
    lines = _lines(docs, classes, pairs)
    # The candidate with most in common is tried first; the others only for classes that it does not remove.
    best = pairs.groupBy("later").agg(F.max(F.struct("weight", "earlier")).alias("best")).select("later", "best.earlier")
    nearest = _verified(lines, best)
    others = pairs.join(nearest.withColumnRenamed("no", "later"), "later", "left_anti")
    return removed.union(nearest).union(_verified(lines, others.join(best, ["later", "earlier"], "left_anti")))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id (the key of the document), line_no of every line to remove; once each."""
    docs = _keyed(docs)
    # Names that several lines have, and the place of the first one.
    copied = _exploded(docs).groupBy("name_a", "name_b").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n"))
    copied = cut(copied.filter("n > 1").drop("n"))
    rows = _stored(_sets(docs, copied).drop("name_a", "name_b"), "line-classes")
    classes = rows.filter("not copy")
    if classes.filter("many").count() > copied.count():  # rows of the same doc_id and text
        classes = classes.dropDuplicates(["doc_id", "line_no"])
    classes = _numbered(classes)
    near = classes.join(_few(cut(_near_lines(docs, classes))), "no", "left_semi")
    # Kept, as it is used by document and is dear to make anew.
    return cut(rows.filter("copy").select("doc_id", "line_no").union(near.select("doc_id", "line_no")).distinct())


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (line numbers in order, from 0)."""
    docs = _keyed(docs)
    gone = removed_lines(docs).groupBy(F.col("doc_id").alias("g_doc")).agg(
        F.sort_array(F.collect_set("line_no")).alias("removed")
    )
    rows = docs.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    met = rows.join(gone, rows["doc_id"] == gone["g_doc"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    doc_id = F.when(F.col("doc_id.id") != MISSING, F.col("doc_id.id")).alias("doc_id")
    return met.select(doc_id, "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the lines to remove taken out of their texts."""
    rows = as_rows(docs)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = with_keys(rows, text, repeated_ids(docs))
    lines = removed_lines(rows.select(F.col("key").alias("doc_id"), text.alias("text")))
    gone = lines.groupBy(F.col("doc_id").alias("gone_doc")).agg(F.collect_set("line_no").alias("removed"))
    # Few numbers go to the texts; else texts and numbers meet by document.
    gone = F.broadcast(gone) if lines.count() <= SENT_LINES else gone
    met = rows.join(gone, F.col("key") == F.col("gone_doc"), "left")
    kept = F.filter(F.split("row.text", "\n"), lambda line, at: ~F.array_contains("removed", at))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return met.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
