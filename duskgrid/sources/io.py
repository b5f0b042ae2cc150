"""Sources and sinks: monthly panels, hourly exposure, entity and plant registers, exclusion dates, state caches."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def own_folder(application: str) -> str:
    """A folder of this application's own, where all is one process: Spark lets no running session set spark.checkpoint.dir."""
    return "file://" + tempfile.mkdtemp(prefix="duskgrid-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = own_folder(spark.sparkContext.applicationId)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class MissingMonths(ValueError):
    """Some expected months are not in the panel."""


def read_panel(spark: SparkSession, path: str, start_month: str, end_month: str, allow_partial: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Months start_month .. end_month (yyyy-MM) of a panel partitioned by month; only columns, if given."""
    panel = spark.read.parquet(path)
    panel = panel.withColumn("month", F.col("month").cast("string")).where(F.col("month").between(start_month, end_month))
    if not allow_partial:
        wanted = spark.sql(f"SELECT date_format(m, 'yyyy-MM') AS month FROM (SELECT explode(sequence(DATE '{start_month}-01', DATE '{end_month}-01', INTERVAL 1 MONTH)) AS m)")
        gone = [r.month for r in wanted.join(panel.select("month").distinct(), "month", "left_anti").orderBy("month").collect()]  # months only
        if gone:
            raise MissingMonths(f"no data for {', '.join(gone)}")
    return panel.select(*columns) if columns else panel


def write_panel(panel: DataFrame, path: str, date: str = "date") -> str:
    """Writes the panel by month; months that it holds replace those at path, others stay."""
    panel.withColumn("month", F.date_format(date, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return path


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Writes df as Parquet in buckets of key, each sorted by it and one file, so that tables written alike join without a shuffle."""
    name = _bucketed_name(path)
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return path


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that write_bucketed has written, in this session or an earlier one: joins and aggregates by key need no shuffle."""
    name = _bucketed_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _bucketed_name(path: str) -> str:
    return "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_table(df: DataFrame, path: str) -> str:
    """Writes a result table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)
    return path


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header by a declared schema, file (a file's name) and refused: the text of a line that doesn't fit it, else null.

    Fields of a refused line that can be read are there, the others are null.
    """
    raw = spark.read.schema(f"{schema}, _refused string").option("columnNameOfCorruptRecord", "_refused").option("mode", "PERMISSIVE").option("escape", '"').csv(path, header=True)
    return raw.select(*[c for c in raw.columns if c != "_refused"], F.col("_metadata.file_name").alias("file"), F.col("_refused").alias("refused"))


def scan_hourly(spark: SparkSession, path: str, ts: str, schema: str) -> DataFrame:
    """hourly_exposure of CSV files. A line whose clock can't be read is refused too; only refused lines lack date or hour."""
    raw = scan_csv(spark, path, schema)
    rows = hourly_exposure(raw.withColumn("_text", F.col(ts)), "_text")
    bad = F.col("date").isNull() | F.col("hour").isNull() | ~F.col("hour").between(0, 23)
    return rows.withColumn("refused", F.coalesce("refused", F.when(F.coalesce(bad, F.lit(True)), F.coalesce(ts, F.lit("")))))


def scan_entities(spark: SparkSession, path: str, schema: str, wkt: str = "wkt") -> DataFrame:
    """CSV of settlements with a WKT point, its x and y as numbers; a line without a point that can be read is refused."""
    raw = scan_csv(spark, path, schema)
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    at = [F.regexp_extract(F.coalesce(wkt, F.lit("")), pattern, i).try_cast("double") for i in (1, 2)]
    rows = raw.withColumns({"x": at[0], "y": at[1]})
    return rows.withColumn("refused", F.coalesce("refused", F.when(F.col("x").isNull() | F.col("y").isNull(), F.coalesce(wkt, F.lit("")))))


def scan_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """date, kind, refused of text files with a date and a class a line; blank lines and lines that begin with # are left out."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split(F.trim("value"), r"[\s,;]+")
    rows = lines.select(F.try_to_timestamp(F.try_element_at(parts, F.lit(1)), F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.lower(F.try_element_at(parts, F.lit(2))).alias("kind"), "value")
    fine = F.col("date").isNotNull() & F.coalesce(F.col("kind").isin("obvious", "maybe"), F.lit(False))
    return rows.select("date", "kind", F.when(~fine, F.col("value")).alias("refused"))


def write_scenes(df: DataFrame, path: str, scene: str = "scene", rows: int = 5_000_000) -> str:
    """Writes df as a folder a scene, a file about each so many of its rows: files follow the rows, not tasks times scenes."""
    parts = df.groupBy(scene).agg(F.ceil(F.count("*") / rows).alias("_parts"))
    dealt = df.join(F.broadcast(parts), scene, "left").repartition(scene, F.pmod(F.xxhash64(*df.columns), F.coalesce("_parts", F.lit(1)))).drop("_parts")  # a row a scene
    dealt.write.partitionBy(scene).parquet(path)
    return path


def scan_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of scenes at any depth, with scene (the name that tells it) and date, the date in the name; null where there is none."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    place = F.col("_metadata.file_path")
    name = F.regexp_extract(place, r"([^/]+)/[^/]+$", 1)
    return rows.withColumns({"scene": name, "date": date_in_name(name)})


def hourly_exposure(raw: DataFrame, ts: str) -> DataFrame:
    """date and hour from a local-clock timestamp that is kept as text, so that no zone can shift it.

    A text that doesn't begin with yyyy-MM-dd HH gives null; check_hourly refuses such a table.
    """
    return raw.withColumns({"date": F.try_to_timestamp(F.substring(ts, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), "hour": F.substring(ts, 12, 2).try_cast("int")}).drop(ts)


def check_hourly(hourly: DataFrame) -> DataFrame:
    if hourly.where("date is null or hour is null or hour not between 0 and 23").limit(1).count():
        raise ValueError("timestamps that can't be read")
    return hourly


def read_hourly_exposure(spark: SparkSession, path: str, ts: str, schema: str) -> DataFrame:
    return check_hourly(hourly_exposure(spark.read.schema(schema).csv(path, header=True), ts))


def load_entities(raw: DataFrame, order: list[str], keep: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """raw with entity, a number by the given order (which must be unique), and the columns kept under new names.

    Numbers come from ranks within ranges of the order and the ranges' sizes, never from one task.
    """
    spread = raw.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    from pyspark.sql import Window

    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = ranked.join(F.broadcast(before), "_part").withColumn("entity", F.col("_rank") + F.col("_before"))
    return out.select("entity", *[F.col(c).alias((rename or {}).get(c, c)) for c in (keep or raw.columns)])


def exclusion_dates(flags: DataFrame, scenario: str) -> DataFrame:
    """Dates that a scenario of a flag table (scenario, date, remove) removes."""
    return flags.where((F.col("scenario") == scenario) & F.col("remove")).select("date").distinct()


def exclusion_dates_text(lines: DataFrame, mode: str, column: str = "value") -> DataFrame:
    """Dates of a text list, a date and a class (`obvious`, `maybe`) a line: none, the obvious, or those and the maybes."""
    parts = F.split(F.trim(column), r"[\s,;]+")
    rows = lines.select(F.to_date(F.try_element_at(parts, F.lit(1))).alias("date"), F.lower(F.try_element_at(parts, F.lit(2))).alias("kind"))
    wanted = {"none": [], "obvious": ["obvious"], "maybe": ["obvious", "maybe"]}[mode]
    return rows.where(F.col("date").isNotNull() & F.col("kind").isin(wanted)).select("date").distinct() if wanted else rows.where("false").select("date")


def date_in_name(name: Column) -> Column:
    """The first yyyy-MM-dd, yyyy_MM_dd or yyyyMMdd in a file name."""
    found = F.regexp_extract(name, r"(20\d\d)[-_]?([01]\d)[-_]?([0-3]\d)", 0)
    return F.try_to_timestamp(F.regexp_replace(found, "[-_]", ""), F.lit("yyyyMMdd")).cast("date")


def harmonise_register(sheets: dict[str, DataFrame], candidates: dict[str, list[str]], fuels: dict[str, str], power_words: str, country: str | None = None) -> DataFrame:
    """Plant registers with differing columns as one: sheet, the candidates' names, capacity as a number, fuel.

    The first candidate column that a sheet has gives a field; capacity is the first number in its text; fuel is the
    label of the first pattern found in type and name. Rows of no known fuel stay only if the text says power_words;
    rows of another country or without plausible coordinates go.
    """
    out = None
    for sheet, df in sheets.items():
        have = {c.lower(): c for c in df.columns}
        fields = {f: F.coalesce(*[F.col(f"`{have[n]}`").cast("string") for n in names if n in have], F.lit(None).cast("string")) for f, names in candidates.items()}
        one = df.select(F.lit(sheet).alias("sheet"), *[c.alias(f) for f, c in fields.items()])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    said = F.lower(F.concat_ws(" ", "type", "name"))
    fuel = F.coalesce(*[F.when(said.rlike(pattern), label) for pattern, label in fuels.items()])
    num = lambda c: F.regexp_extract(F.regexp_replace(F.col(c), ",", ""), r"-?\d+(\.\d+)?", 0).try_cast("double")
    rows = out.withColumns({"capacity": num("capacity"), "lon": num("lon"), "lat": num("lat"), "fuel": fuel})
    rows = rows.where((F.col("fuel").isNotNull() | said.rlike(power_words)) & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    return rows if country is None else rows.where(F.lower("country") == country.lower())


def state_cache(spark: SparkSession, folder: str, parameters: dict, build, mode: str = "auto") -> DataFrame:
    """The table that build() makes, kept in folder under a hash of its parameters.

    auto: read it if it is there, else build; full: build anew; metrics_only: it must be there.
    """
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/states-{key}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    if mode == "metrics_only" and not there:
        raise FileNotFoundError(path)
    if mode == "full" or not there:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def month_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Of each month of a panel a fingerprint of its files: names, sizes and times of change. Only the file system is asked."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for folder in fs.listStatus(top):
        name = folder.getPath().getName()
        if name.startswith("month="):
            files = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(folder.getPath()) if not f.getPath().getName().startswith(("_", ".")))
            out[name.removeprefix("month=")] = hashlib.sha256(json.dumps(files).encode()).hexdigest()[:24]
    return out


def monthly_states(spark: SparkSession, panel: str, folder: str, n: int = 30, lit_at: float = 0.4, dark_below: float = 0.05, least_obs: int = 8, least_lit: int = 15) -> tuple[DataFrame, list[str]]:
    """Daily states of a panel by month (operators.states.daily_states of its dense form), kept in folder month by month.

    A month's rolling sums look n - 1 days ahead, so it is made of its own files and of those of the months that these days
    reach (the halo). It is made anew when one of these files or a rule has changed, when the panel's first or last day has
    and lies within its reach, and when the entities have, as each has rows in all months. Of each month also its entities,
    their first and last days and their first triggers are kept; the first of these over the months is doe, so no earlier
    month is read again. All months to be made go in one job. What is kept is listed in a manifest that is written last:
    a run that fails leaves the one before in force. Returns the states and the months that were made.
    """
    from pyspark.sql import Window

    from duskgrid.operators import states as S

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in fs.listStatus(top)) if fs.exists(top) else []
    ready = [x for x in names if x.startswith("manifest-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/_SUCCESS"))]
    kept = json.loads(spark.read.option("wholetext", "true").text(f"{folder}/{ready[-1]}").first()[0]) if ready else {"facts": {}, "states": {}}
    files = month_files(spark, panel)
    months = sorted(files)
    if not months:
        raise MissingMonths(f"no months in {panel}")
    run = f"{folder}/run-{uuid.uuid4().hex}"

    def read(parts: list[str]) -> DataFrame:
        return spark.read.option("basePath", panel).parquet(*[f"{panel}/month={m}" for m in parts])

    fresh = [m for m in months if kept["facts"].get(m, [""])[0] != files[m]]
    if fresh:
        by_month = F.date_format("date", "yyyy-MM").alias("month")
        read(fresh).groupBy("entity", by_month).agg(F.min("date").alias("first"), F.max("date").alias("last")).write.partitionBy("month").parquet(f"{run}/facts")
    facts = {m: [files[m], f"{run}/facts/month={m}"] if m in fresh else kept["facts"][m] for m in months}
    known = spark.read.parquet(*[path for _, path in facts.values()])
    start, end = known.agg(F.min("first"), F.max("last")).first()
    entities = known.select("entity").distinct()
    crowd = entities.agg(F.count("*"), F.bit_xor(F.xxhash64("entity"))).first()
    ahead = {r["m"]: r["last"] for r in spark.createDataFrame([(m,) for m in months], "m string").select("m", F.date_add(F.last_day(F.to_date(F.concat("m", F.lit("-01")))), n - 1).alias("last")).collect()}  # a row a month
    rules = [n, lit_at, dark_below, least_obs, least_lit]

    def mark(m: str) -> str:
        near = [x for x in months if m <= x <= str(ahead[m])[:7]]
        told = [rules, [[x, files[x]] for x in near], list(crowd), str(start) if str(start)[:7] == m else "", str(end) if ahead[m] >= end else ""]
        return hashlib.sha256(json.dumps(told).encode()).hexdigest()[:24]

    marks = {m: mark(m) for m in months}
    made = [m for m in months if kept["states"].get(m, [""])[0] != marks[m]]
    if made:
        near = [x for x in months if any(m <= x <= str(ahead[m])[:7] for m in made)]
        spans = spark.createDataFrame([(m, ahead[m]) for m in made], "month string, last date")
        begin = F.greatest(F.to_date(F.concat("month", F.lit("-01"))), F.lit(start))
        days = spans.select("month", F.explode(F.sequence(begin, F.least("last", F.lit(end)))).alias("date"))
        grid = entities.crossJoin(F.broadcast(days))  # a month and its halo a month: bounded by the calendar
        dense = grid.join(read(near).select("entity", "date", "p", "coverage"), ["entity", "date"], "left")
        own = S.rolling_forward(S.lit_dark(dense, lit_at, dark_below), n, least_obs, least_lit, ["entity", "month"]).where(F.date_format("date", "yyyy-MM") == F.col("month"))
        first = F.min(F.when(F.col("electrified") == 1, F.col("date"))).over(Window.partitionBy("entity", "month"))
        own.withColumn("first_in_month", first).write.partitionBy("month").parquet(f"{run}/states")
    states = {m: [marks[m], f"{run}/states/month={m}"] if m in made else kept["states"][m] for m in months}
    if made or fresh or set(kept["states"]) != set(months):
        following = int(ready[-1].rsplit("-", 1)[1]) + 1 if ready else 1
        spark.createDataFrame([(json.dumps({"facts": facts, "states": states}),)], "value string").coalesce(1).write.text(f"{folder}/manifest-{following:08d}")
    parts = spark.read.parquet(*[path for _, path in states.values()])
    does = parts.groupBy("entity").agg(F.min("first_in_month").alias("doe"))
    out = parts.drop("first_in_month").join(does, "entity")
    return out.withColumn("after_doe", F.when(F.col("date") >= F.col("doe"), 1).otherwise(0)), made
