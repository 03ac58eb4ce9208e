"""Files and databases: stop lists, points, suggested routes, paged exports."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

STOP_SCHEMA = "Latitude double, Longitude double, Heading double, Description string, RoadName string, BusStopCode string"


def index_stops(raw: DataFrame, order: str) -> DataFrame:
    """Stops with their place in the list as ``idx`` (given before the filter); unplaced stops go, unknown headings are NaN.

    A stop list has thousands of rows, so one ordered partition numbers it.
    """
    numbered = raw.withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)
    placed = numbered.filter((F.col("Longitude") != 0) & (F.col("Latitude") != 0))
    return placed.select(
        "idx", F.col("Longitude").alias("lng"), F.col("Latitude").alias("lat"), F.coalesce("Heading", F.lit(float("nan"))).alias("heading"),
        F.col("Description").alias("description"), F.col("RoadName").alias("road"), F.col("BusStopCode").alias("code"),
    )


def read_stops(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of stops, in the order of the file."""
    whole = spark.read.schema("value string").text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", f"array<struct<{STOP_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("pos", "stop"))
    return index_stops(items.select("pos", "stop.*"), "pos")


def read_travel(spark: SparkSession, path: str, factor: float = 1.5) -> DataFrame:
    """The travel-time edge list, scaled for peak traffic."""
    return peak(spark.read.parquet(path), factor)


def peak(travel: DataFrame, factor: float = 1.5) -> DataFrame:
    return travel.withColumn("ms", F.col("ms") * factor)


def write_travel(travel: DataFrame, path: str, partitions: int = 64) -> None:
    """Partitioned by source stop, so a lookup of few sources reads few files."""
    travel.repartitionByRange(partitions, "src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), partitions: int = 16, **properties: str) -> DataFrame:
    """A database table, in parallel ranges of ``column`` if given; simple filters are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def append_routes(df: DataFrame, path: str) -> None:
    """Append (id, seed_id, user_id, route_id, admin_email, route, created_ms) to the sink."""
    df.write.mode("append").parquet(path)


def latest_routes(routes: DataFrame, seed_id: int) -> DataFrame:
    """Routes of a seed, newest first, with the status read from their JSON."""
    return routes.filter(F.col("seed_id") == seed_id).withColumn("status", F.get_json_object("route", "$.status")).orderBy(F.desc("id"))


def parse_points(line: Column) -> Column:
    """'DIST N (x y weight)*' as a distance and points; N is read and not used."""
    parts = F.filter(F.split(line, r"\s+"), lambda p: p != "")
    numbers = F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p.cast("double"))
    at = F.when(F.size(numbers) >= 3, F.sequence(F.lit(0), F.floor(F.size(numbers) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    points = F.transform(at, lambda i: F.struct(F.element_at(numbers, i * 3 + 1).alias("x"), F.element_at(numbers, i * 3 + 2).alias("y"), F.element_at(numbers, i * 3 + 3).alias("weight")))
    return F.struct(parts[0].cast("double").alias("distance"), points.alias("points"))


def next_unmarked(stops: DataFrame) -> DataFrame:
    """One placed stop without a heading, the first by code."""
    return stops.filter(F.col("heading").isNull() & F.col("code").isNotNull() & (F.col("lng") != 0)).orderBy("code").limit(1)


def set_heading(stops: DataFrame, marks: DataFrame) -> DataFrame:
    """The stops with headings from ``marks`` (code, heading), normalised to 0..360."""
    new = marks.select("code", F.pmod(F.col("heading") + 360, F.lit(360.0)).alias("_h"))
    return stops.join(new, "code", "left").withColumn("heading", F.coalesce("_h", "heading")).drop("_h")


# ------------------------------------------------------------- paged exports


class _Pages(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(None)
        self.names = names


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


class _PagedReader(DataSourceReader):
    """Pages <prefix>-0.json, <prefix>-1.json, .. of each prefix up to its first empty or missing one; each a JSON object with a list under ``field``."""

    def __init__(self, options):
        self.path, self.field, self.each = options["path"], options.get("field", "value"), int(options.get("pagesperpartition", 8))
        self.prefixes = json.loads(options.get("prefixes", '["page"]'))

    def partitions(self):
        system, root = _system(self.path)
        names = []
        for prefix in self.prefixes:
            for n in range(1 << 20):
                name = f"{root}/{prefix}-{n}.json"
                if system.get_file_info(name).type.name != "File" or not self._rows(system, name):
                    break
                names.append(name)
        return [_Pages(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [_Pages([])]

    def _rows(self, system, name: str) -> list:
        with system.open_input_stream(name) as file:
            return json.loads(file.read())[self.field]

    def read(self, partition):
        system, _ = _system(self.path)
        for name in partition.names:
            for row in self._rows(system, name):
                yield (json.dumps(row),)


class PagedJson(DataSource):
    """``format("paged_json")``: an export in pages, one JSON text a row."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _PagedReader(self.options)


def read_paged(spark: SparkSession, path: str, schema: str, field: str = "value", prefixes: list[str] | None = None) -> DataFrame:
    """An export in pages; with ``prefixes`` one run of pages for each search prefix, as of a search by "00", "01", .. "99"."""
    spark.dataSource.register(PagedJson)
    rows = spark.read.format("paged_json").options(field=field, prefixes=json.dumps(prefixes or ["page"])).load(path)
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


# ------------------------------------------------------------- answers of routers

ROUTER_SCHEMA = "src long, dst long, time long, points array<array<double>>, instructions array<struct<sign:string,time:long>>"
DIRECTIONS_SCHEMA = "src long, dst long, routes array<struct<legs:array<struct<duration_in_traffic:struct<value:long>>>,overview_polyline:struct<points:string>>>"


def read_router(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers of a road router, one JSON object a line, as (legs, points, steps).

    legs: (src, dst, ms), null where no route was found; points: (src, dst, k, lat, lng); steps: (src, dst, k, ms, turn).
    """
    rows = spark.read.schema(ROUTER_SCHEMA).json(path)
    points = rows.select("src", "dst", F.posexplode("points").alias("k", "p")).select("src", "dst", "k", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lng"))
    steps = rows.select("src", "dst", F.posexplode("instructions").alias("k", "i")).select("src", "dst", "k", F.col("i.time").alias("ms"), F.col("i.sign").alias("turn"))
    return rows.select("src", "dst", F.col("time").alias("ms")), points, steps


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a directions service, one JSON object a line: (src, dst, ms, polyline).

    The time is that of all legs of the first route in traffic, in milliseconds; null without a route.
    """
    first = F.try_element_at("routes", F.lit(1))
    seconds = F.aggregate(F.transform(first["legs"], lambda leg: leg["duration_in_traffic"]["value"]), F.lit(0).cast("long"), lambda s, x: s + x)
    return spark.read.schema(DIRECTIONS_SCHEMA).json(path).select("src", "dst", (seconds * 1000).alias("ms"), first["overview_polyline"]["points"].alias("polyline"))


# ------------------------------------------------------------- annotations


def annotation_file(path: str) -> str:
    """The working copy of a stop list, beside it and named by a digest of its first 4,096 bytes; made if it isn't there.

    A copy that is there must hold as many stops as the list, or ``ValueError`` says that it is corrupt.
    """
    system, own = _system(path)
    with system.open_input_stream(own) as file:
        data = file.read()
    copy = f"{own.rpartition('/')[0] or '.'}/with-headings-{hashlib.md5(data[:4096], usedforsecurity=False).hexdigest()}.json"
    if system.get_file_info(copy).type.name == "File":
        with system.open_input_stream(copy) as file:
            if len(json.loads(file.read())) != len(json.loads(data)):
                raise ValueError(f"{copy} doesn't hold the stops of {path}")
    else:
        with system.open_output_stream(copy, compression=None) as file:
            file.write(data)
    return copy


def annotate(copy: str, index: int, heading: float) -> dict:
    """Sets the heading of one stop of a working copy; the stop as it is now."""
    if isinstance(heading, bool) or not isinstance(heading, int | float):
        raise TypeError("a heading is a number")
    system, own = _system(copy)
    with system.open_input_stream(own) as file:
        stops = json.loads(file.read())
    stops[index] = {**stops[index], "Heading": heading}
    with system.open_output_stream(own, compression=None) as file:
        file.write(json.dumps(stops, indent=2).encode())
    return stops[index]
