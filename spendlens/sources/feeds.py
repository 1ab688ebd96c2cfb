"""Reading the four feeds as text and keeping an inventory of them."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The documented columns of each feed.
EXPECTED: dict[str, list[str]] = {
    "ad_performance_daily": [
        "date", "campaign_id", "creative_id", "impressions", "clicks",
        "conversions", "spend", "revenue", "currency",
    ],
    "campaigns": [
        "campaign_id", "campaign_name", "channel", "objective", "currency",
        "daily_budget", "start_date", "end_date",
    ],
    "creatives": ["creative_id", "campaign_id", "creative_name", "format", "headline", "launched_on"],
    "fx_rates": ["date", "currency", "rate_to_usd"],
}

Feeds = dict[str, DataFrame]

HEADERS_AT_ONCE = 16


# Text of a CSV row that does not have as many fields as its file's header.
MALFORMED = "_corrupt_record"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != MALFORMED]


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def first_line(spark: SparkSession, path: str, multiline: bool = False) -> str | None:
    """The first line of a file, None where it is empty; no more of the file is read than a buffer at a time.

    Goes through the file system that holds the file and the codec its name asks for.
    With ``multiline`` a line that ends inside quotes goes on with the next.
    """
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        text = stream if codec is None else codec.createInputStream(stream)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"))
        line = lines.readLine()
        while multiline and line is not None and line.count('"') % 2:
            more = lines.readLine()
            if more is None:
                break
            line += "\n" + more
        return line
    finally:
        stream.close()


def csv_headers(spark: SparkSession, path: str, multiline: bool = False) -> dict[str, list[str]]:
    """The files of a feed by their first line.

    Files come from the listing that any reader of the folder makes, and each is opened
    for its first buffer only, some at a time: no job runs and no body is read. Empty
    files have no rows and are left out.
    """
    uri, place = spark.sparkContext._jvm.java.net.URI, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = sorted(place(uri(name)).toString() for name in spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        lines = list(pool.map(lambda file: first_line(spark, file, multiline), files))
    headers: dict[str, list[str]] = {}
    for file, line in zip(files, lines, strict=True):
        if line is not None:
            headers.setdefault(line, []).append(file)
    return headers


def read_csv_by_name(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV files as text columns under the names of each file's own header.

    Files of one folder may order their columns differently or lack some: those with
    the same header are read together under it, and the parts are joined by name, a
    column that a file lacks being NULL. Rows with too many or too few fields are
    kept and carry their whole text in ``MALFORMED``.
    """
    parts = None
    headers = csv_headers(spark, path, multiline) or {None: [path]}
    for header, files in sorted(headers.items(), key=lambda x: (x[0] or "", x[1])):
        names = next(csv.reader([(header or "").removeprefix("\ufeff")]), [])
        fields = [*dict.fromkeys(n.strip() for n in names), MALFORMED]
        schema = StructType([StructField(n, StringType()) for n in fields])
        # A row is only known to be malformed when all its fields are parsed.
        reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False)
        part = reader.csv(files, header=True, mode="PERMISSIVE", escape='"', multiLine=multiline)
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts.select(*data_columns(parts), MALFORMED)


def read_feeds(
    spark: SparkSession, folder: str, fmt: str = "csv", multiline: bool = False, allow_missing: bool = False
) -> Feeds:
    """Open every feed with all columns as text, under their header names.

    Types are never inferred: that would turn bad values into NULL before anyone
    could count them. A feed is ``<folder>/<name>.<fmt>``, one file or a folder of
    files. ``multiline`` allows line breaks inside quotes, at the price of files
    that can no longer be split between tasks. CSV feeds carry ``MALFORMED`` as well,
    which the inventory and the audit count. With ``allow_missing`` a feed that is
    not there is left out, and those two report it.
    """
    feeds: Feeds = {}
    missing = []
    for name in EXPECTED:
        path = f"{folder.rstrip('/')}/{name}.{fmt}"
        try:
            if fmt == "csv":
                feeds[name] = read_csv_by_name(spark, path, multiline)
            else:
                feeds[name] = _as_text(spark.read.format(fmt).load(path))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(f"{name}.{fmt}")
    if missing and not allow_missing:
        raise FileNotFoundError(f"missing {', '.join(missing)} in {folder}")
    return feeds


def feed_counts(feeds: Feeds) -> DataFrame:
    """Rows per feed."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("feed"), "n_rows")
        for name, df in feeds.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def malformed_rows(df: DataFrame) -> Column:
    """Aggregate: rows that did not fit their header. Another column is read with it, as CSV requires."""
    if MALFORMED not in df.columns:
        return F.lit(0).cast("bigint")
    beside = data_columns(df)[0]
    return F.count(F.when(F.col(MALFORMED).isNotNull(), F.struct(beside)))


def feed_inventory(
    feeds: Feeds, expected: dict[str, list[str]] | None = None, spark: SparkSession | None = None
) -> DataFrame:
    """Rows, malformed rows and column drift per feed; missing feeds and columns block, extra ones inform.

    ``spark`` is needed only when no feed is there at all.
    """
    spark = spark or next(iter(feeds.values())).sparkSession
    parts = []
    for name, wanted in (expected or EXPECTED).items():
        df = feeds.get(name)
        present = [] if df is None else data_columns(df)
        lacking = [c for c in wanted if c not in present]
        extra = [c for c in present if c not in wanted]
        severity = "BLOCKER" if lacking else "INFO" if extra else None
        if df is None:
            counts = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in ("n_rows", "malformed_rows")])
        else:
            counts = df.agg(F.count("*").alias("n_rows"), malformed_rows(df).alias("malformed_rows"))
        parts.append(
            counts.select(
                F.lit(name).alias("feed"),
                "n_rows",
                "malformed_rows",
                F.lit(len(present)).cast("bigint").alias("n_columns"),
                F.lit(", ".join(lacking)).alias("missing_columns"),
                F.lit(", ".join(extra)).alias("extra_columns"),
                F.lit(severity).cast("string").alias("severity"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
