"""Calendar pages and timetables: HTML or extracted text to rounds and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import latest, scan
from apexline.functions.texts import plain_blanks
from apexline.operators.results import berlin_ms

# Timetable labels by the start of their printed name, first match wins.
LABELS = (
    ("zeittraining", "quali"), ("qualifying", "quali"), ("quali", "quali"),
    ("pitwalk", "pitwalk"), ("gridwalk", "lineup"), ("startaufstellung", "startaufstellung"),
    ("boxengasse", "pitlane"), ("pitlane", "pitlane"), ("warm-up", "formation"),
    ("einführungsrunde", "formation"), ("formation", "formation"), ("rennen", "race"),
)
# German month names.
MONTHS = (
    "januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober",
    "november", "dezember",
)
WEEKDAYS = "Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag"
ROUND_LINK = r'<a href="([^"]+)"[^>]*>\s*NLS(\d+)\s*:\s*([^<]*)<'
_DAY = (
    rf"(?:{WEEKDAYS}),\s*(\d{{1,2}})\.\s*((?iu:{'|'.join(MONTHS)}))(?![A-Za-zäöüÄÖÜ])\s*(\d{{4}})?"
)
_TIME = r"(\d{1,2}:\d{2})\s*(?:[–-]\s*(\d{1,2}:\d{2}))?\s*Uhr"
_BLOCK, _FIELD, _REST = "\u0001", "\u0002", "\u0003"


def harvest_calendar(pages: DataFrame) -> DataFrame:
    """Rounds of calendar rows with a round link; a date range gives two days."""
    rows = pages.select(
        F.explode(F.regexp_extract_all("html", F.lit(r"<tr>([\s\S]*?)</tr>"), F.lit(1))).alias("r")
    ).filter(F.col("r").rlike(ROUND_LINK))
    double = r"<td>\s*(\d{2})\.-(\d{2})\.(\d{2})\.(\d{4})\s*</td>"
    single = r"<td>\s*(\d{2})\.(\d{2})\.(\d{4})\s*</td>"

    def date(pattern, day, month, year):
        return F.concat_ws(
            "-", *[F.regexp_extract("r", pattern, i) for i in (year, month, day)]
        )

    dates = F.when(
        F.col("r").rlike(double), F.array(date(double, 1, 3, 4), date(double, 2, 3, 4))
    ).when(F.col("r").rlike(single), F.array(date(single, 1, 2, 3)))
    return rows.select(
        F.explode(dates).alias("event_date"),
        F.regexp_extract("r", ROUND_LINK, 1).alias("url"),
        F.regexp_extract("r", ROUND_LINK, 2).alias("round_no"),
        F.trim(F.regexp_extract("r", ROUND_LINK, 3)).alias("title"),
    )


def _label_key(name):
    return F.trim(F.regexp_replace(F.lower(name), r"\(.*?\)", ""))


def harvest_timetable(pages: DataFrame) -> DataFrame:
    """Sessions of the two-column table after the timetable heading.

    pages: event_date, html.
    """
    cells = r"<tr>\s*<td>([^<]*)</td>\s*<td>([^<]*)</td>\s*</tr>"
    body = F.regexp_extract("html", r">Zeitplan<[\s\S]*?(<table[\s\S]*?</table>)", 1)
    rows = pages.withColumn("_t", body).select(
        "event_date",
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("_t", F.lit(cells), F.lit(1)).alias("time"),
                F.regexp_extract_all("_t", F.lit(cells), F.lit(2)).alias("name"),
            )
        ).alias("at", "x"),
    )
    key = _label_key(F.col("x.name"))
    label = F.coalesce(*[F.when(key.startswith(name), value) for name, value in LABELS])
    time = F.trim(F.regexp_replace("x.time", "&#8211;|&#8212;|&ndash;|&mdash;", "-"))
    span = r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})"
    start = F.coalesce(
        F.nullif(F.regexp_extract(time, span, 1), F.lit("")),
        F.nullif(F.regexp_extract(time, r"^(\d{1,2}:\d{2})", 1), F.lit("")),
    )
    return rows.select(
        "event_date", "at", label.alias("label"), start.alias("start"),
        F.nullif(F.regexp_extract(time, span, 2), F.lit("")).alias("end"),
    ).filter("label is not null and start is not null")


def anchored_timetable(
    texts: DataFrame, series: str, labels: dict[str, str],
    pair: tuple[str, str, str] | None, required: tuple[str, ...], default_year: str,
) -> DataFrame:
    """Sessions of one series in timetables without line breaks.

    texts: source, text. Times and day headers are marked, the text is split at
    the marks, and each entry takes the last day header before it. `pair` names
    a start and a finish entry that make one window, and its label. A source
    without all required labels gives nothing.
    """
    day = f"{_BLOCK}D{_FIELD}$1{_FIELD}$2{_FIELD}$3{_REST}"
    time = f"{_BLOCK}T{_FIELD}$1{_FIELD}$2{_REST}"
    marked = F.regexp_replace(F.regexp_replace(plain_blanks("text"), _DAY, day), _TIME, time)
    year = F.coalesce(
        F.nullif(F.regexp_extract("text", r"\b(20\d{2})\b", 1), F.lit("")), F.lit(default_year)
    )
    def opened(block):
        fields = F.split(F.split_part(block, F.lit(_REST), F.lit(1)), _FIELD)
        return F.struct(
            fields[0].alias("kind"), F.get(fields, 1).alias("a"), F.get(fields, 2).alias("b"),
            F.get(fields, 3).alias("c"), F.split_part(block, F.lit(_REST), F.lit(2)).alias("rest"),
        )

    parts = F.split(marked, _BLOCK)
    items = texts.select("source", year.alias("_year"), F.posexplode(parts).alias("at", "block"))
    read = items.filter("at > 0").select("source", "_year", "at", opened(F.col("block")).alias("e"))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower("e.b"))
    dated = read.withColumn(
        "_day",
        F.when(
            F.col("e.kind") == "D",
            F.concat_ws(
                "-", F.coalesce(F.nullif("e.c", F.lit("")), "_year"),
                F.lpad(month.cast("string"), 2, "0"), F.lpad("e.a", 2, "0"),
            ),
        ),
    )
    # A source is one text, so its entries fit where the text did.
    along = scan(dated, ["source"], ["at"], {"event_date": latest("_day")}, hot=False)
    rest = F.trim(F.split_part(F.col("e.rest"), F.lit("*"), F.lit(1)))
    name = F.trim(
        F.regexp_replace(
            F.trim(F.substr(rest, F.lit(len(series) + 1))), r"^(GE|GP|NO)\s+", ""
        )
    )
    entries = along.filter(
        (F.col("e.kind") == "T") & rest.startswith(series) & F.col("event_date").isNotNull()
    ).select(
        "source", "event_date", "at", F.col("e.a").alias("start"),
        F.nullif("e.b", F.lit("")).alias("end"), _label_key(name).alias("key"),
    ).filter("key <> ''")
    flat = [F.lit(x) for item in labels.items() for x in item]
    label = F.try_element_at(F.create_map(*flat), F.col("key"))
    plain = entries.filter(~F.col("key").isin(*(pair[:2] if pair else ("",)))).select(
        "source", "event_date", label.alias("label"),
        berlin_ms(F.col("event_date"), F.col("start")).alias("start_ts"),
        berlin_ms(F.col("event_date"), F.col("end")).alias("end_ts"), "at",
    ).filter("label is not null and start_ts is not null")
    if pair:
        opens, closes, pair_label = pair
        stamp = F.struct("at", "event_date", berlin_ms(F.col("event_date"), F.col("start")).alias("ts"))
        ends = entries.groupBy("source").agg(
            F.max(F.when(F.col("key") == opens, stamp)).alias("s"),
            F.max(F.when(F.col("key") == closes, stamp)).alias("f"),
        )
        fused = ends.filter("s.ts is not null and f.ts is not null").select(
            "source", F.col("s.event_date").alias("event_date"), F.lit(pair_label).alias("label"),
            F.col("s.ts").alias("start_ts"), F.col("f.ts").alias("end_ts"), F.col("s.at").alias("at"),
        )
        plain = plain.unionByName(fused)
    if not required:
        return plain
    present = (
        plain.filter(F.col("label").isin(*required))
        .groupBy("source").agg(F.count_distinct("label").alias("n"))
        .filter(F.col("n") == len(required))
    )
    return plain.join(present.select("source"), "source", "left_semi")
