"""Result-sheet, lap-chart, calendar and timetable queries.

Sheets are composed from the season's rows and parsed back. A sheet holds the
at most fifty cars of one event and number block, so more cars make more texts.
"""

from functools import cached_property

from pyspark.sql import functions as F

from apexline.functions.session import cut
from apexline.operators import results
from apexline.plans.pits import meetings
from apexline.plans.registry import part, query, sql
from apexline.plans.results import Season
from apexline.sources import pages, sheets
from apexline.sources.standins import minutes_text
from apexline.sources.tables import table

MODELS = ("Porsche 911 GT3 Cup", "BMW M4", "Mercedes-AMG GT", "VW Golf", "AUDI R8")
FIRST_NAMES = ("Hans", "Jörg", "D'Arcy", "Zoë")
PLACES = ("Köln", "Niederlande", "Schweiz", "Bad Neuenahr", "Österreich", "Vereinigte Staaten")
HEADER = (
    "1. ADAC Testrennen Seite 1 Pl. Nr. Klasse Fahrer, Ort Strafzeit Intervall Gesamt Schnitt Rd. "
)
FOOTER = " nicht gestartet : 3 Datenservice: Zeitnahme Meckenheim"


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _driver(k):
    """A driver as printed, from the key."""
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    licence = F.concat(
        _pick(("DE-", "NL-", "", "XX-"), k % 4), 1000 + k % 9000, F.when(k % 7 == 0, " &5").otherwise("")
    )
    return F.struct(
        k.alias("o_custkey"),
        F.concat(F.initcap(F.concat(F.lit("mo"), letters)), F.lit(" "), _pick(FIRST_NAMES, k % 4)).alias("name"),
        F.when((k % 13 == 0) & (k % 4 != 2), "").otherwise(_pick(PLACES, k % 6)).alias("place"),
        licence.alias("licence"),
        F.when(k % 3 == 0, " PRO").otherwise("").alias("rated"),
    )


class Sheets(Season):
    @cached_property
    def cars_listed(self):
        """One row per event and car, with everything printed about it and its drivers, at most three, in order of key."""
        # Keys are gathered, and what is printed made from them, so that no texts are sorted or sent.
        keys = self.drives.groupBy("event_date", "car_no").agg(F.array_sort(F.collect_set("o_custkey")).alias("keys"))
        day = F.unix_date(F.to_date("event_date")).cast("bigint")
        c = F.col("car_no")
        return keys.join(self.cars.select("event_date", "car_no", "status"), ["event_date", "car_no"]).select(
            F.concat_ws("/", "event_date", F.expr("car_no div 50")).alias("event"),
            (c % 50 + 1).alias("num"), "car_no", "status", day.alias("day"),
            F.concat_ws(
                " ", F.concat(F.lit("SP"), c % 9),
                F.when(c % 3 == 0, "PRO/AM").when(c % 3 == 1, "AM"),
            ).alias("class_full"),
            _pick(MODELS, c % 5).alias("model"),
            (10 + c % 15).alias("laps"),
            (480_000 + (c * 7919 + day) % 60_000).alias("car_ms"),
            F.transform("keys", _driver).alias("d"),
        )

    def _corpus(self, line, header="", footer="", gap=" "):
        """A text per event: its at most fifty lines by number."""
        rows = self.cars_listed.select("event", F.struct("num", line.alias("line")).alias("x"))
        lines = F.array_sort(F.collect_list("x"))["line"]
        texts = rows.groupBy("event").agg(
            F.concat(F.lit(header), F.array_join(lines, gap), F.lit(footer)).alias("text")
        )
        # Parsing costs far more than its bytes suggest, so small corpora spread too.
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return texts.repartition(parts, "event")

    @cached_property
    def sheets(self):
        place = (F.col("num") * 7) % 50 + 1
        dsq = F.when(F.col("status") == "dsq", " *DSQ").otherwise("")
        people = F.array_join(
            F.transform(
                "d",
                lambda d, i: F.concat(
                    d["name"], F.lit(", "), d["place"], F.when(d["place"] != "", " ").otherwise(""),
                    d["licence"], F.when(i == F.size("d") - 1, dsq).otherwise(d["rated"]),
                ),
            ),
            " ",
        )
        line = F.concat_ws(
            " ", F.when(F.col("status") != "dnf", place), "num", "class_full", "model", "laps",
            F.lit("4:01:02.345 148.231"), minutes_text(F.col("car_ms")),
            F.when(F.col("car_no") % 8 != 0, F.concat(F.lit("B:Team "), _team(), F.lit(" AB12")))
            .otherwise("S:Sponsor"),
            people,
        )
        return self._corpus(line, HEADER, FOOTER)

    @cached_property
    def charts(self):
        names = F.array_join(
            F.transform("d", lambda d, i: F.concat(d["name"], F.lit(" ("), i + 1, F.lit(")"))), " "
        )

        def lap(d, i, n):
            ms = 480_000 + (d["o_custkey"] * (31 + n) + F.col("day")) % 90_000
            return F.concat(
                minutes_text(ms), F.lit(" "), F.lit("pit" if n == 2 else str(n)), F.lit("("), i + 1,
                F.lit(")"),
            )

        times = F.array_join(
            F.flatten(F.transform("d", lambda d, i: F.array(lap(d, i, 1), lap(d, i, 2)))), " "
        )
        head = F.when(F.col("num") % 2 == 0, F.lit(sheets.CHART_HEADER))
        return self._corpus(
            F.concat_ws(" ", head, "num", F.lit("Team X"), names, times),
            sheets.CHART_HEADER + " ", FOOTER.replace(" nicht gestartet : 3", ""),
        )

    @cached_property
    def qualifying(self):
        line = F.concat_ws(
            " ", F.when(F.col("num") % 9 != 0, (F.col("num") * 7) % 50 + 1), "num", "class_full",
            F.when(F.col("num") % 5 == 0, "BITTER Corsa").otherwise(F.col("model")), "laps",
            minutes_text(F.col("car_ms")), F.lit("150.123"), F.col("d")[0]["name"].alias("n"),
        )
        return self._corpus(F.concat(line, F.lit(", Köln DE-1234")), HEADER, FOOTER)


def _team():
    return _pick(("Alpha", "Bravo", "Charlie", "Delta", "Echo", "Foxtrot", "Golf"),
                 F.col("car_no") % 7)


part(
    "entry_row",
    """
SELECT event_date || '/' || (car_no // 50) AS event, car_no % 50 + 1 AS num, car_no, o_custkey AS k, status,
  CAST(event_date AS DATE) - DATE '1970-01-01' AS day,
  row_number() OVER (PARTITION BY event_date, car_no ORDER BY o_custkey) AS driver_no
FROM (SELECT DISTINCT event_date, car_no, o_custkey FROM drive) JOIN car USING (event_date, car_no)""",
    "drive", "car",
)
part(
    "head",
    """
SELECT DISTINCT event, num, car_no, status, day, CASE WHEN status <> 'dnf' THEN num * 7 % 50 + 1 END AS pos,
  'SP' || (car_no % 9) AS class,
  CASE car_no % 3 WHEN 0 THEN ' PRO/AM' WHEN 1 THEN ' AM' ELSE '' END AS suffix,
  CASE car_no % 3 WHEN 0 THEN 'PRO-AM' WHEN 1 THEN 'AM' END AS rating,
  ['Porsche 911 GT3 Cup', 'BMW M4', 'Mercedes-AMG GT', 'VW Golf', 'AUDI R8'][car_no % 5 + 1] AS model,
  10 + car_no % 15 AS laps, 480000 + (car_no * 7919 + day) % 60000 AS car_ms,
  CASE WHEN car_no % 8 <> 0 THEN 'Team ' ||
    ['Alpha', 'Bravo', 'Charlie', 'Delta', 'Echo', 'Foxtrot', 'Golf'][car_no % 7 + 1] END AS team
FROM entry_row""",
    "entry_row",
)
part(
    "chart_lap",
    """
SELECT e.event, e.num AS car_no, e.driver_no, 480000 + (e.k * (31 + n.n) + e.day) % 90000 AS ms
FROM entry_row e, (SELECT 1 AS n UNION ALL SELECT 2) n
JOIN (SELECT event, num, count(*) AS drivers, lead(num) OVER (PARTITION BY event ORDER BY num) AS next_num
  FROM entry_row GROUP BY event, num) c ON c.event = e.event AND c.num = e.num
WHERE NOT (n.n = 2 AND e.driver_no = c.drivers AND coalesce(c.next_num, 0) % 2 = 1)""",
    "entry_row",
)
part(
    "person",
    r"""
SELECT event, num AS car_no, driver_no, 'Mo' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') || ' '
    || ['Hans', 'Jörg', 'D''Arcy', 'Zoë'][k % 4 + 1] AS driver_name,
  lower('mo' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') || ' '
    || ['hans', 'jorg', 'darcy', 'zoe'][k % 4 + 1]) AS driver_key,
  CASE WHEN bare THEN '' ELSE ['Köln', 'Niederlande', 'Schweiz', 'Bad Neuenahr', 'Österreich',
    'Vereinigte Staaten'][k % 6 + 1] END AS place,
  ['DE-', 'NL-', '', 'XX-'][k % 4 + 1] || (1000 + k % 9000) || CASE WHEN k % 7 = 0 THEN ' &5' ELSE '' END
    AS license_no,
  CASE WHEN NOT bare AND k % 6 = 1 THEN 'NL' WHEN NOT bare AND k % 6 = 2 THEN 'CH'
    WHEN NOT bare AND k % 6 = 4 THEN 'AT' WHEN NOT bare AND k % 6 = 5 THEN 'US'
    WHEN k % 4 = 0 THEN 'DE' WHEN k % 4 = 1 THEN 'NL' WHEN NOT bare THEN 'DE' END AS nationality
FROM (SELECT *, k % 13 = 0 AND k % 4 <> 2 AS bare FROM entry_row)""",
    "entry_row",
)


@query(
    "parse_result_sheets",
    sql(
        """
SELECT event, num AS car_no, pos AS pos_overall, class || suffix AS class_full, class, rating,
  model AS car_model, laps, team, car_ms AS first_lap_ms, status FROM head""",
        "head",
    ),
)
def _(spark, folder):
    return sheets.parse_result_sheets(Sheets(spark, folder).sheets).drop("at", "zone", "head_ms")


@query(
    "explode_drivers",
    sql(
        "SELECT event, car_no, driver_no, driver_name, driver_key, place, license_no, nationality"
        " FROM person",
        "person",
    ),
)
def _(spark, folder):
    cars = sheets.parse_result_sheets(Sheets(spark, folder).sheets)
    return sheets.explode_drivers(cars).select(
        "event", "car_no", "driver_no", "driver_name", "driver_key", "place", "license_no",
        "nationality",
    )


@query(
    "driver_best_laps",
    sql("SELECT event, car_no, driver_no, min(ms) AS ms FROM chart_lap GROUP BY ALL", "chart_lap"),
)
def _(spark, folder):
    return sheets.driver_best_laps(Sheets(spark, folder).charts)


@query(
    "attach_best_lap",
    sql(
        """
SELECT e.event, e.num AS car_no, e.driver_no, coalesce(o.ms, h.car_ms) AS best_lap_ms, o.ms = c.ms AS set_fastest
FROM entry_row e JOIN head h ON h.event = e.event AND h.num = e.num
LEFT JOIN (SELECT event, car_no, driver_no, min(ms) AS ms FROM chart_lap GROUP BY ALL) o
  ON o.event = e.event AND o.car_no = e.num AND o.driver_no = e.driver_no
LEFT JOIN (SELECT event, car_no, min(ms) AS ms FROM chart_lap GROUP BY ALL) c
  ON c.event = e.event AND c.car_no = e.num""",
        "entry_row", "head", "chart_lap",
    ),
)
def _(spark, folder):
    corpus = Sheets(spark, folder)
    # Sheets and charts are made from the same cars.
    corpus.cars_listed = cut(corpus.cars_listed)
    drivers = sheets.explode_drivers(sheets.parse_result_sheets(corpus.sheets)).select(
        F.col("event").alias("event_date"), "car_no", F.col("driver_no").alias("at"),
        "first_lap_ms",
    )
    laps = sheets.driver_best_laps(corpus.charts).withColumnRenamed("event", "event_date")
    return results.attach_best_lap(drivers, laps).select(
        F.col("event_date").alias("event"), "car_no", F.col("at").alias("driver_no"),
        "best_lap_ms", "set_fastest",
    )


@query(
    "qualifying_grid",
    sql(
        """
SELECT *, row_number() OVER (PARTITION BY event, class ORDER BY pos_overall, car_no) AS pos_class FROM (
  SELECT event, num AS car_no, num * 7 % 50 + 1 AS pos_overall, car_ms AS best_lap_ms,
    class || suffix || CASE WHEN num % 5 = 0 THEN ' BITTER Corsa' ELSE '' END AS class FROM head
  WHERE num % 9 <> 0)""",
        "head",
    ),
)
def _(spark, folder):
    return sheets.qualifying_grid(Sheets(spark, folder).qualifying)


# ---- pages -----------------------------------------------------------------


def calendar_pages(spark, folder):
    """A page per month listing its order dates; and the given pages as they are."""
    d = F.to_date("event_date")
    two = F.date_format(d, "dd")
    later = F.date_format(F.date_add(d, 1), "dd")
    day = F.col("day")
    spans = (day % 3 == 0) & (F.month(F.date_add(d, 1)) == F.month(d))
    when = F.concat(
        two, F.when(spans, F.concat(F.lit(".-"), later)).otherwise(""), F.date_format(d, ".MM.yyyy")
    )
    link = F.when(
        day % 7 != 0,
        F.concat(
            F.lit('<a href="/r/'), "day", F.lit('" class="x"> NLS'), day % 10, F.lit(" : Cup of "),
            "day", F.lit(" </a>"),
        ),
    ).otherwise("no round")
    row = F.concat(F.lit("<tr><td> "), when, F.lit(" </td><td>"), link, F.lit("</td></tr>"))
    listed = meetings(spark, folder).select(
        F.date_format(d, "yyyy-MM").alias("month"), F.struct("event_date", row.alias("row")).alias("x")
    )
    # At most the days of a month in a page.
    composed = listed.groupBy("month").agg(
        F.concat(
            F.lit("<table>"), F.array_join(F.array_sort(F.collect_list("x"))["row"], "\n"),
            F.lit("</table>"),
        ).alias("html")
    )
    return composed.select("html").union(table(spark, folder, "pages").select("html"))


@query(
    "harvest_calendar",
    sql(
        """
SELECT event_date, '/r/' || day AS url, CAST(day % 10 AS VARCHAR) AS round_no, 'Cup of ' || day AS title
FROM meeting WHERE day % 7 <> 0
UNION ALL SELECT CAST(CAST(event_date AS DATE) + 1 AS VARCHAR), '/r/' || day, CAST(day % 10 AS VARCHAR),
  'Cup of ' || day FROM meeting WHERE day % 7 <> 0 AND day % 3 = 0
  AND month(CAST(event_date AS DATE) + 1) = month(CAST(event_date AS DATE))""",
        "meeting",
    ),
)
def _(spark, folder):
    return pages.harvest_calendar(calendar_pages(spark, folder))


def timetable_pages(spark, folder):
    """A page per order date with a timetable; and the given pages as they are."""
    day = F.col("day")
    rows = F.concat(
        F.when(
            day % 2 == 0,
            "<tr> <td>8:30 &#8211; 10:00 Uhr</td> <td>Zeittraining (Quali)</td> </tr>",
        ).otherwise("<tr><td>08:45 Uhr</td><td>Qualifying</td></tr>"),
        F.lit("<tr><td>10:15</td><td>Fanmeile</td></tr>"),
        F.lit("<tr><td>abends</td><td>Pitwalk</td></tr>"),
        F.when(day % 4 != 0, "<tr><td>12:00&ndash;16:00</td><td>Rennen (4 Stunden)</td></tr>")
        .otherwise(""),
    )
    html = F.concat(F.lit("<table><tr><td>9:00</td><td>Rennen</td></tr></table><h3>Zeitplan</h3>"
                          "<table class='z'>"), rows, F.lit("</table>"))
    composed = meetings(spark, folder).select("event_date", html.alias("html"))
    given = table(spark, folder, "pages").select(F.lit(None).cast("string").alias("event_date"), "html")
    return composed.union(given)


@query(
    "harvest_timetable",
    sql(
        """
SELECT event_date, 'quali' AS label, CASE WHEN day % 2 = 0 THEN '8:30' ELSE '08:45' END AS start,
  CASE WHEN day % 2 = 0 THEN '10:00' END AS "end" FROM meeting
UNION ALL SELECT event_date, 'race', '12:00', '16:00' FROM meeting WHERE day % 4 <> 0""",
        "meeting",
    ),
)
def _(spark, folder):
    return pages.harvest_timetable(timetable_pages(spark, folder)).drop("at")


SERIES = "ADAC 24h Test"


def timetable_texts(spark, folder):
    """One long text per order date: two days of entries of two series."""
    d = F.to_date("event_date")
    month = _pick(
        ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September",
         "Oktober", "November", "Dezember"),
        F.month(d) - 1,
    )
    day = F.col("day")
    first = F.concat(F.lit("Freitag, "), F.dayofmonth(d), F.lit(". "), month, F.lit(" "), F.year(d))
    text = F.concat(
        F.lit("Zeitplan Stand 05:00 Uhr vorab "), first,
        F.lit(f" 8:30 – 10:00 Uhr {SERIES} GE Qualifying 1 (Gruppe A)"),
        F.lit(" 9:15 Uhr Andere Serie Qualifying 2 Freitag, 31. Foober"),
        F.when(day % 5 != 0, f" 15:00 Uhr {SERIES} Start Rennen").otherwise(""),
        F.lit(f" 14:00 - 14:20 Uhr {SERIES} Warm-Up Samstag, 1. "), month,
        F.lit(f" 11:00 Uhr {SERIES} Startaufstellung 16:00 Uhr {SERIES} NO Zieleinlauf * Fußnote"),
    )
    return meetings(spark, folder).select(F.col("event_date").alias("source"), text.alias("text"))


_AT = (
    "epoch_ms({d}) + {clock} - CASE WHEN {d} >= (make_date(year({d}), 3, 31)"
    " - CAST(dayofweek(make_date(year({d}), 3, 31)) AS INTEGER)) AND {d} < (make_date(year({d}), 10, 31)"
    " - CAST(dayofweek(make_date(year({d}), 10, 31)) AS INTEGER)) THEN 7200000 ELSE 3600000 END"
)


def _entry(label, date, start, end, where):
    return (
        f"SELECT source, CAST({date} AS VARCHAR) AS event_date, '{label}' AS label,"
        f" {_AT.format(d=date, clock=start)} AS start_ts, "
        + ("CAST(NULL AS BIGINT)" if end is None else end)
        + f" AS end_ts FROM tt WHERE {where}"
    )


@query(
    "anchored_timetable",
    sql(
        """
, tt AS (SELECT event_date AS source, CAST(event_date AS DATE) AS d,
  -- years before 2000 are no default year, so the header without one falls back
  make_date(CASE WHEN event_date >= '2000' THEN year(CAST(event_date AS DATE)) ELSE 2026 END,
    month(CAST(event_date AS DATE)), 1) AS f, day FROM meeting WHERE day % 5 <> 0)
"""
        + " UNION ALL ".join(
            [
                _entry("quali1", "d", 30600000, _AT.format(d="d", clock=36000000), "true"),
                _entry("warmup", "d", 50400000, _AT.format(d="d", clock=51600000), "true"),
                _entry("startaufstellung", "f", 39600000, None, "true"),
                _entry("race", "d", 54000000, _AT.format(d="f", clock=57600000), "true"),
            ]
        ),
        "meeting",
    ),
)
def _(spark, folder):
    labels = {
        "qualifying 1": "quali1", "warm-up": "warmup", "startaufstellung": "startaufstellung",
    }
    found = pages.anchored_timetable(
        timetable_texts(spark, folder), SERIES, labels, ("start rennen", "zieleinlauf", "race"),
        ("race",), "2026",
    )
    return found.drop("at")
