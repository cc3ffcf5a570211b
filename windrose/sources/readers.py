"""Readers with fixed schemas, and landed text as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AIR_QUALITY = "station_id string, station_name string, lat double, lon double, pm25 double, aqi int, observed string"


def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


#: Reference airports and runways, and the headerless air-quality file.
AIRPORTS = "ident string, name string, lat double, lon double, elevation_ft int, iso_region string, icao_code string, gps_code string"
RUNWAYS = "airport_ident string, length_ft int, surface string, lighted boolean, closed boolean, le_ident string, le_heading double, he_ident string"


def oversized(spark: SparkSession, path: str, most: int = 1_000_000) -> DataFrame:
    """(file, bytes) of the files that ``bulletins`` leaves out for their length."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes")).where(F.col("length") > most)


def newest_files(spark: SparkSession, path: str, n: int, before: str | None = None) -> DataFrame:
    """(file, at) of the ``n`` files changed last, newest first; contents are not read."""
    reader = spark.read.format("binaryFile")
    if before:
        reader = reader.option("modifiedBefore", before)
    return reader.load(path).select(F.col("path").alias("file"), F.col("modificationTime").alias("at")).orderBy(F.desc("at"), "file").limit(n)


def granules(rows: DataFrame, columns: list[str], lat: str = "lat", lon: str = "lon", fill: float = 1e30) -> DataFrame:
    """Landed granule rows: fill values become null, rows without a sane place go."""
    clean = rows.withColumns({c: F.when(F.abs(c) <= fill, F.col(c)) for c in columns})
    return clean.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def feature_collection(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(feature) GeoJSON points as text, one a row, for ``write.text``; a writer that needs one file joins them."""
    place = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    rest = F.struct(*[c for c in rows.columns if c not in (lat, lon)])
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), rest.alias("properties"))).alias("feature"))


def bulletins(spark: SparkSession, path: str, since: str | None = None, most: int = 1_000_000, prefixes: str | None = None) -> DataFrame:
    """(file, report) of text bulletins: reports end at "="; files over ``most`` characters are left out (see ``oversized``).

    ``prefixes``: first letters that a report's station must have.
    """
    reader = spark.read
    if since:
        reader = reader.option("modifiedAfter", since)
    files = reader.text(path, wholetext=True).where(F.length("value") <= most).select(F.col("_metadata.file_path").alias("file"), "value")
    reports = files.select("file", F.explode(F.split("value", "=")).alias("report"))
    reports = reports.select("file", F.trim(F.regexp_replace("report", r"\s+", " ")).alias("report")).where("report != ''")
    return reports.where(F.col("report").rlike(rf"^(?:(?:METAR|SPECI|TAF|AMD|COR) )*[{prefixes}][A-Z0-9]{{3}} ")) if prefixes else reports


def access_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(ip, at, request, status) of web-server lines, of ``since`` (a time such as 2024-01-01 00:00:00 UTC) and later; lines of another form are left out."""
    form = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3})'
    part = lambda i: F.regexp_extract("value", form, i)
    lines = spark.read.text(path).where(F.col("value").rlike(form))
    if since:
        lines = lines.where(F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")) >= F.lit(since).cast("timestamp"))
    return lines.select(part(1).alias("ip"), part(2).alias("at"), part(3).alias("request"), part(4).cast("int").alias("status"))
