"""Result sheets, lap charts and qualifying sheets: extracted text to rows.

A corpus has one row per sheet: event (its key) and text. Each sheet's text is
processed whole: heads are marked by one regular expression, the text is split
at the marks, and each block is read by itself.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import number, scan
from apexline.functions.texts import plain_blanks
from apexline.functions.times import lap_text_ms

# Manufacturer names that open a vehicle field, longer ones first.
MAKES = (
    "Mercedes-AMG", "Aston Martin", "Porsche", "BMW", "Mercedes", "Audi", "McLaren", "Ferrari",
    "Mitsubishi", "Toyota", "Cupra", "Hyundai", "Renault", "Ford", "Lamborghini", "Honda", "KTM",
    "Opel", "MINI", "Mini", "Alpine", "Nissan", "Lexus", "Bentley", "Chevrolet", "Corvette",
    "Ginetta", "Seat", "Volkswagen", "VW", "Subaru", "Dacia", "Ligier", "Donkervoort", "Peugeot",
    "Skoda", "Lada", "MARC", "Glickenhaus", "Wolf",
)
# Driver ratings, as printed after a licence and after a class.
RATINGS = ("AM", "PRO", "PRO-AM", "PRO/AM", "SILVER", "GOLD", "PLATINUM", "BRONZE")
CLASS_RATINGS = "PRO-AM|PRO/AM|PRO|AM|SILVER|GOLD|PLATINUM|BRONZE"
# Country as printed in the place column, to ISO code.
COUNTRIES = {
    "Schweiz": "CH", "Niederlande": "NL", "Vereinigtes Königreich": "GB", "Südafrika": "ZA",
    "Irland": "IE", "Bulgarien": "BG", "Armenien": "AM", "Türkei": "TR", "Slowakei": "SK",
    "Japan": "JP", "Luxemburg": "LU", "Norwegen": "NO", "Frankreich": "FR", "Südkorea": "KR",
    "Vereinigte Arabische Emirate": "AE", "Dänemark": "DK", "Chile": "CL",
    "Vereinigte Staaten": "US", "Argentinien": "AR", "Italien": "IT", "Kirgisistan": "KG",
    "Tschechien": "CZ", "Israel": "IL", "Belgien": "BE", "Österreich": "AT", "Spanien": "ES",
    "Portugal": "PT", "Schweden": "SE", "Finnland": "FI", "Polen": "PL", "Ungarn": "HU",
    "Kroatien": "HR", "Griechenland": "GR", "Estland": "EE", "Litauen": "LT", "Lettland": "LV",
    "Rumänien": "RO", "Monaco": "MC", "Liechtenstein": "LI", "Ecuador": "EC", "Brasilien": "BR",
    "Kanada": "CA", "Australien": "AU", "Neuseeland": "NZ", "China": "CN", "Katar": "QA",
    "Saudi-Arabien": "SA", "Mexiko": "MX", "Thailand": "TH", "Slowenien": "SI", "Indien": "IN",
    "Russland": "RU", "Ukraine": "UA", "Deutschland": "DE", "Andorra": "AD", "Malta": "MT",
    "Zypern": "CY", "Island": "IS", "Hongkong": "HK", "Singapur": "SG", "Indonesien": "ID",
    "Philippinen": "PH", "Venezuela": "VE", "Uruguay": "UY", "Kolumbien": "CO", "Norwegia": "NO",
}
# Licence prefixes that name a country.
LICENCE_COUNTRIES = (
    "DE NL GB CH FR IT BE AT ES NO SE DK FI PL CZ SK HU LU IE PT ZA JP KR US CA AU AR BR CL MC TR"
    " BG HR RO GR LI LT LV EE IL AE QA SA CN MX EC KG AM IN SG HK"
).split()
# Page furniture of the printed sheets.
FURNITURE = (
    r"\d+\.\s+[A-ZÄÖÜ][\s\S]*?Fahrer, Ort Strafzeit Intervall Gesamt Schnitt Rd\.",
    r"Datenservice:[\s\S]*?(?:Rheinbrohl|Meckenheim)",
    r"Seite \d+ / Gedruckt[\s\S]*?\d+:\d+",
    r"nicht gestartet : \d+",
    r"\b(?:DNC|DNS|DNF)\b",
)
CHART_HEADER = "No Entrant Driver"
CHART_FOOTER = r"Datenservice:[\s\S]*?(?:Rheinbrohl|Meckenheim)"

_ANY_MAKE = "|".join(
    dict.fromkeys(
        form.replace("-", r"\-")
        for make in MAKES
        for form in (make, make.upper(), make.lower())
    )
)
# Shape of a car's head line, and the looser one anchored on times.
HEAD = (
    r"(?<![A-Za-z0-9&/\-])(?:(\d{1,3}) )?(\d{1,3}) ([A-Z][^,:.]{0,18}?) (" + _ANY_MAKE
    + r")((?: [^,:.]{1,20}){0,6}?) (\d{1,3}) (\d{1,2}:\d{2}(?::\d{2})?\.\d{3})(?=\s)"
)
LOOSE_HEAD = (
    r"(?<![\w&/-])(\d{1,3}) (\d{1,3}) ([A-Z][\s\S]*?) (\d{1,3})"
    r" (\d{1,2}:\d{2}(?::\d{2})?\.\d{3}) \d{1,3}\.\d{3}(?=\s)"
)
CHART_HEAD = r"(?:^|\)|\|)\s*(\d{1,3})\s+(?:(?!\d{1,2}:\d{2}\.\d{3})[^|])*?\(1\)"
CHART_LAP = r"(\d{1,2}:\d{2}\.\d{3}) (?:\d+|pit)\((\d+)\)"
TEAM = r"B:([^,]+?)\s+(?:[A-Z0-9][^\s]*\d[^\s]*|\d[^\s]*)\s"
DRIVER_ZONE = r"""([A-ZÀ-Þ'"][^,]{1,45}, [A-ZÀ-Þ"'][\s\S]*)"""

# Tokens on single blanks. What stands between two commas: a place, a licence from its first token on, ratings;
# the next driver's name follows.
_ENDS = r"(?: |\z)"
_LICENCE = r"\S*\d|[A-Z]{1,3}-"
_RATING = "|".join("[.,]*" + "".join(letter + "[.,]*" for letter in name) for name in RATINGS)
_DRIVEN = (
    rf"^((?:(?!{_LICENCE})\S++{_ENDS})*+)((?:(?={_LICENCE}|\*)\S++{_ENDS})*+)(?:(?:{_RATING}){_ENDS})*+"
)
# A name up to its last token that no name contains.
_FOREIGN = rf"""(?s)^(?:.* )?(?:\S*[0-9"&:]\S*|{_RATING}|[.,]*[SB][.,]*){_ENDS}"""

_BLOCK, _FIELD, _REST = "\u0001", "\u0002", "\u0003"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Sheet text without page furniture, on single blanks."""
    text = plain_blanks(text)
    for pattern in FURNITURE:
        text = F.regexp_replace(text, pattern, " ")
    return _squeezed(text)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _blocks(corpus: DataFrame, pattern: str, fields: str) -> DataFrame:
    """One row per head: its captured fields and the text up to the next head."""
    marked = F.regexp_replace(clean_text(F.col("text")), pattern, f"{_BLOCK}{fields}{_REST}")
    parts = corpus.select("event", F.posexplode(F.split(marked, _BLOCK)).alias("at", "block"))
    return parts.filter("at > 0").select(
        "event", "at",
        F.split(F.split_part("block", F.lit(_REST), F.lit(1)), _FIELD).alias("f"),
        F.split_part("block", F.lit(_REST), F.lit(2)).alias("after"),
    )


def parse_result_sheets(corpus: DataFrame) -> DataFrame:
    """One row per car head of each sheet, with the text of its drivers."""
    fields = _FIELD.join(f"${i}" for i in (1, 2, 3)) + f"{_FIELD}$4$5{_FIELD}$6{_FIELD}$7"
    heads = _blocks(corpus, HEAD, fields)
    klass = F.trim(F.col("f")[2])
    split_rating = rf"(?i)^(.*?)\s+({CLASS_RATINGS})$"
    rating = _found(klass, split_rating, 2)
    position = F.nullif(F.col("f")[0], F.lit("")).cast("bigint")
    return heads.select(
        "event", "at",
        position.alias("pos_overall"),
        F.col("f")[1].cast("bigint").alias("car_no"),
        klass.alias("class_full"),
        F.when(rating.isNotNull(), F.trim(F.regexp_extract(klass, split_rating, 1)))
        .otherwise(klass).alias("class"),
        F.replace(F.upper(rating), F.lit("/"), F.lit("-")).alias("rating"),
        F.trim(F.col("f")[3]).alias("car_model"),
        F.col("f")[4].cast("bigint").alias("laps"),
        lap_text_ms(F.col("f")[5]).alias("head_ms"),
        F.trim(_found(F.col("after"), TEAM)).alias("team"),
        lap_text_ms(F.regexp_extract("after", r"(\d{1,2}:\d{2}\.\d{3})", 1)).alias("first_lap_ms"),
        F.when(F.col("after").rlike(r"(?i)\*+DSQ"), "dsq")
        .when(position.isNotNull(), "classified").otherwise("dnf").alias("status"),
        _found(F.col("after"), DRIVER_ZONE).alias("zone"),
    )


@cache
def _folding() -> tuple[str, str]:
    """Lower-case letters that are one letter with combining marks, and that letter."""
    pairs = {}
    for code in range(0xC0, 0x30000):
        letter = chr(code).lower()
        if len(letter) == 1 and unicodedata.decomposition(letter):
            parts = unicodedata.normalize("NFD", letter)
            base = "".join(c for c in parts if not "\u0300" <= c <= "\u036f")
            if len(base) == 1 and base != letter and len(parts) > 1:
                pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


def fold_key(name: Column) -> Column:
    """Lower case, no diacritics, no quotes, dots, commas or stars, single blanks."""
    accented, plain = _folding()
    lower = F.lower(name)
    bare = F.when(lower.rlike("[^\\x00-\\x7f]"), F.translate(lower, accented, plain)).otherwise(lower)
    return _squeezed(F.regexp_replace(bare, r"""[̀-ͯ'".,*]""", ""))


def _clean_name(name: Column) -> Column:
    """The trailing tokens of a name, on single blanks, after the last one no name contains."""
    text = F.regexp_replace(F.regexp_replace(name, _FOREIGN, ""), r"""^['"]|['"]$""", "")
    return F.trim(F.regexp_replace(text, r"\*+$", ""))


def _mapped(values: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def explode_drivers(cars: DataFrame) -> DataFrame:
    """The drivers of each car in printed order.

    The zone reads "Name, Place Licence [Rating] Name, Place Licence ...": each
    piece after a comma holds a place, a licence and the next driver's name.
    """
    pieces = cars.filter("zone is not null").withColumn("_p", F.transform(F.split("zone", ", "), _squeezed))
    # A car's drivers come from one row, so its names are told and numbered there.
    after = lambda p, i: F.when(i == 0, F.get("_p", F.lit(0))).otherwise(F.regexp_replace(F.get("_p", i), _DRIVEN, ""))
    people = F.transform(
        F.slice("_p", 2, F.size("_p") - 1), lambda p, i: F.struct(_clean_name(after(p, i)).alias("name"), p.alias("piece"))
    )
    numbered = pieces.select(*cars.columns, F.posexplode(F.filter(people, lambda x: x["name"] != "")).alias("_i", "_x"))
    tidy = numbered.select(
        *cars.columns, (F.col("_i") + 1).cast("bigint").alias("driver_no"), F.col("_x.name").alias("driver_name"),
        F.trim(F.regexp_extract("_x.piece", _DRIVEN, 1)).alias("_place"),
        F.trim(F.regexp_extract("_x.piece", _DRIVEN, 2)).alias("_licence"),
    )
    place = F.regexp_replace("_place", r"(?i),?\s*\*+DSQ$", "")
    place = F.trim(F.regexp_replace(place, ",$", ""))
    licence = F.nullif(
        F.trim(F.regexp_replace("_licence", r"(?i)\*+DSQ", "")), F.lit("")
    )
    tidy = tidy.select(
        *cars.columns, "driver_no", "driver_name", place.alias("place"), licence.alias("license_no")
    )
    prefix = F.regexp_extract(F.coalesce("license_no", F.lit("")), "^([A-Z]{2})-", 1)
    return tidy.select(
        *[c for c in cars.columns if c != "zone"], "driver_no", "driver_name",
        fold_key(F.col("driver_name")).alias("driver_key"), "place", "license_no",
        F.coalesce(
            _mapped(COUNTRIES, F.col("place")),
            _mapped({c: c for c in LICENCE_COUNTRIES}, prefix),
            F.when(F.col("place") != "", "DE"),
        ).alias("nationality"),
    )


def driver_best_laps(charts: DataFrame) -> DataFrame:
    """Fastest lap of each driver number of each car on the lap charts."""
    text = F.replace(plain_blanks("text"), F.lit(CHART_HEADER), F.lit(" | "))
    text = _squeezed(F.regexp_replace(text, CHART_FOOTER, " "))
    marked = F.regexp_replace(text, CHART_HEAD, f"{_BLOCK}$1{_REST}$0")
    parts = charts.select("event", F.posexplode(F.split(marked, _BLOCK)).alias("at", "block"))
    body = F.split_part("block", F.lit(_REST), F.lit(2))
    laps = parts.filter("at > 0").select(
        "event",
        F.split_part("block", F.lit(_REST), F.lit(1)).cast("bigint").alias("car_no"),
        F.explode(F.regexp_extract_all(body, F.lit(CHART_LAP), F.lit(0))).alias("x"),
    )
    driver = F.rtrim(F.split_part("x", F.lit("("), F.lit(2)), F.lit(")")).cast("bigint")
    return laps.groupBy("event", "car_no", driver.alias("driver_no")).agg(
        F.min(lap_text_ms(F.split_part("x", F.lit(" "), F.lit(1)))).alias("ms")
    )


def qualifying_grid(corpus: DataFrame) -> DataFrame:
    """Starting grid: heads with a place first, then cars only the loose shape finds."""
    strict = parse_result_sheets(corpus).filter("pos_overall is not null").select(
        "event", "car_no", F.lit(0).alias("loose"), "at", "pos_overall",
        F.col("class_full").alias("class"), F.col("head_ms").alias("best_lap_ms"),
    )
    fields = _FIELD.join(f"${i}" for i in (1, 2, 3, 5))
    middle = F.col("f")[2]
    label = F.coalesce(
        F.nullif(F.trim(F.regexp_extract(middle, rf"^([\s\S]+?) (?:{_ANY_MAKE}) ", 1)), F.lit("")),
        F.trim(middle),
    )
    loose = _blocks(corpus, LOOSE_HEAD, fields).select(
        "event", F.col("f")[1].cast("bigint").alias("car_no"), F.lit(1).alias("loose"), "at",
        F.col("f")[0].cast("bigint").alias("pos_overall"), label.alias("class"),
        lap_text_ms(F.col("f")[3]).alias("best_lap_ms"),
    )
    first = strict.unionByName(loose).groupBy("event", "car_no").agg(
        F.min_by(F.struct("pos_overall", "class", "best_lap_ms"), F.struct("loose", "at")).alias("x")
    ).select("event", "car_no", "x.*")
    # An event is one text, so its cars fit where the text did.
    return scan(
        first, ["event", "class"], ["pos_overall", "car_no"], {"pos_class": number()}, hot=False
    )
