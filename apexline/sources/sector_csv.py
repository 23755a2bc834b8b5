"""Sector CSV: ';'-separated Latin text, one row per car and lap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexline.functions.texts import stripped
from apexline.functions.times import clock_ms, pit_ms

# The export's column names.
COLUMNS = (
    "STNR", "RUNDE_NR", "KLASSEKURZ", "TAGESZEIT", "RUNDENZEIT_IN_SEKUNDEN",
    *(f"SEKTOR{i}_ZEIT" for i in range(1, 6)), *(f"SEKTOR{i}_KMH" for i in range(1, 6)),
    "INPIT", "PITIN_TIME", "PITSTOPDURATION", "DIESCHNELLSTE", "FAHRER_NR",
    *(f"FAHRER{i}_NAME" for i in range(1, 9)), "FAHRZEUG",
)
# Windows Latin text is read as ISO Latin; the 27 characters in which they differ are put right after.
_CONTROLS = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
_AS_READ = "".join(map(chr, _CONTROLS))
_AS_MEANT = bytes(_CONTROLS).decode("cp1252")


def _layouts(spark: SparkSession, path) -> dict[str, list[str]]:
    """Files by their header line; a table of files, not of rows."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.filter(F.col("value").contains("RUNDE_NR") & F.col("value").contains("STNR"))
    found: dict[str, list[str]] = {}
    for row in heads.groupBy("file").agg(F.min("value").alias("head")).collect():
        found.setdefault(row["head"], []).append(row["file"])
    return found


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Export rows as text, by header name, with their file; columns a file lacks are null.

    Files with the same header are one scan; a header holds for its own files only.
    """
    parts = []
    for files in _layouts(spark, path).values():
        rows = spark.read.csv(sorted(files), sep=";", encoding="ISO-8859-1", header=True)
        named = {stripped_name(c): c for c in rows.columns}
        columns = [
            F.translate(F.col(f"`{named[c]}`"), _AS_READ, _AS_MEANT) if c in named else F.lit(None).cast("string")
            for c in COLUMNS
        ]
        file = F.col("_metadata.file_name").alias("file")
        parts.append(rows.select(*[col.alias(c) for col, c in zip(columns, COLUMNS)], file))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*COLUMNS, "file")))
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    return both


def stripped_name(name: str) -> str:
    return name.strip().lstrip("\u00ef\u00bb\u00bf")


def read_sector_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw laps of one or more export files."""
    return normalise(read_rows(spark, path))


def active_driver(rows: DataFrame) -> DataFrame:
    """Name of the driver whose number the row gives, else the first listed."""
    first = stripped("FAHRER1_NAME")
    listed = F.array(*[stripped(f"FAHRER{i}_NAME") for i in range(1, 9)])
    at = stripped("FAHRER_NR").try_cast("int") - 1
    return rows.withColumn(
        "driver", F.coalesce(F.nullif(F.get(listed, at), F.lit("")), first)
    )


def normalise(rows: DataFrame) -> DataFrame:
    """Typed raw laps; rows without any sector time are dropped. Times in ms."""
    kmh = [F.col(f"SEKTOR{i}_KMH") for i in range(1, 6)]
    dotted = [F.replace(stripped(v), F.lit(","), F.lit(".")).try_cast("decimal(18,2)") for v in kmh]
    # Looked at as text, so that the times are not worked out twice.
    texts = [stripped(f"SEKTOR{i}_ZEIT") for i in range(1, 6)]
    shown = F.coalesce(*[F.nullif(F.nullif(t, F.lit("")), F.lit("-")) for t in texts])
    return active_driver(rows.filter(shown.isNotNull())).select(
        stripped("STNR").alias("car"),
        stripped("RUNDE_NR").try_cast("bigint").alias("lap"),
        stripped("KLASSEKURZ").alias("klass"),
        F.array(*[clock_ms(F.col(f"SEKTOR{i}_ZEIT")) for i in range(1, 6)]).alias("s"),
        F.array(*[(v * 100).cast("bigint") for v in dotted]).alias("spd"),
        clock_ms(F.col("TAGESZEIT")).alias("tend"),
        clock_ms(F.col("RUNDENZEIT_IN_SEKUNDEN")).alias("rt"),
        F.coalesce(stripped("INPIT") == "J", F.lit(False)).alias("inpit"),
        stripped("INPIT").alias("pit_status"),
        pit_ms(F.col("PITIN_TIME")).alias("pit_in"),
        pit_ms(F.col("PITSTOPDURATION")).alias("pit_dur"),
        F.coalesce(stripped("DIESCHNELLSTE") == "J", F.lit(False)).alias("fastest"),
        "driver",
        stripped("FAHRZEUG").alias("vehicle"),
    )
