"""Readers: recordings and logs in CSV, text and Parquet as DataFrames of the long model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.errors import SourceError
from pulsegrid.schema import CHANNELS, LOG_CSV

#: Order in which a stream id is searched for a modality. Fixed values.
ROUTE = ["EEG", "PPG", "ACC", "GYRO", "BVP", "TEMP", "GSR"]
#: A known misspelling in raw logs and what it stands for. Fixed values.
TYPO = ("Sstart_YNC", "start_SYNC")


def modality_of(stream: Column) -> Column:
    """The first modality whose name is in a stream id; null where none is."""
    return F.coalesce(*[F.when(F.upper(stream).contains(m), F.lit(m)) for m in ROUTE])


def sensor_location(stream: Column) -> Column:
    """head for headband streams, wrist for ids with digits, else unknown."""
    s = F.lower(stream)
    return F.when(s.contains("muse"), "head").when(s.rlike("[0-9]"), "wrist").otherwise("unknown")


def file_stem(column: str = "_metadata.file_name") -> Column:
    return F.regexp_replace(F.col(column), r"\.[^.]*$", "")


def read_csv(spark: SparkSession, path: str, columns: list[str], schema: str | None = None) -> DataFrame:
    """The named columns of CSV files with a header; rows with a missing value are dropped. Types are those of `schema`;
    without it they are found by reading the files once more. Raises if a column is missing or no row is left."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise SourceError(f"{path} lacks {', '.join(missing)}")
    rows = df.select(*columns).dropna("any")
    if rows.isEmpty():
        raise SourceError(f"{path} has no complete row")
    return rows


def read_recordings(spark: SparkSession, path: str, modality: str, session: int) -> DataFrame:
    """Wide CSV files `<stream>.csv` with a timestamp in seconds and a column per channel, as long rows.

    The position of a reading is its rank in time within its file."""
    names = CHANNELS[modality]
    schema = ", ".join(["timestamp double", *[f"`{c}` double" for c in names]])
    df = spark.read.option("header", True).schema(schema).csv(path).select("*", file_stem().alias("stream_id"))
    long = df.select("stream_id", "timestamp", F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in names])))
    ts = F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    pos = F.row_number().over(Window.partitionBy("stream_id", "channel").orderBy("timestamp")) - 1
    return long.select(F.lit(session).alias("session"), "stream_id", F.lit(modality).alias("modality"), pos.cast("bigint").alias("pos"), ts.alias("ts"), "channel", "value")


def infer_modality(df: DataFrame) -> str:
    """The modality of a headerless table of numbers: four or five columns are EEG; three are ACC if their mean variance
    is below 1, else GYRO; one is TEMP if it spans less than 10, GSR if less than 100, else BVP."""
    n = len(df.columns)
    if n in (4, 5):
        return "EEG"
    if n == 3:
        v = df.agg(*[F.var_samp(c) for c in df.columns]).first()
        return "ACC" if sum(x or 0.0 for x in v) / 3 < 1 else "GYRO"
    if n == 1:
        c = df.columns[0]
        span = df.agg((F.max(c) - F.min(c))).first()[0] or 0.0
        return "TEMP" if span < 10 else "GSR" if span < 100 else "BVP"
    raise SourceError(f"no modality has {n} columns")


#: Sampling rate in Hz that files without times are taken to have. Fixed value.
UNTIMED_RATE = 256.0


def read_untimed(spark: SparkSession, path: str, session: int) -> DataFrame:
    """Headerless CSV files `<stream>.csv` of one modality, found from the numbers (see infer_modality), as long rows. The
    instants of a file follow one another at UNTIMED_RATE from 1970 on; a fifth column of an EEG file is dropped.

    Rows are numbered in the order of the file: a file is one split."""
    df = spark.read.option("inferSchema", True).csv(path, header=False)
    modality = infer_modality(df)
    names = CHANNELS[modality][: 4 if modality == "EEG" else None]
    w = Window.partitionBy("stream_id").orderBy("_n")
    rows = df.select("*", file_stem().alias("stream_id"), F.monotonically_increasing_id().alias("_n")).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).cast("double").alias("value")) for n, c in zip(names, df.columns)]))
    long = rows.select("stream_id", "pos", each)
    ts = F.timestamp_micros((F.col("pos") * (1_000_000 / UNTIMED_RATE)).cast("bigint")).cast("timestamp_ntz")
    return long.select(F.lit(session).alias("session"), "stream_id", F.lit(modality).alias("modality"), "pos", ts.alias("ts"), "channel", "value")


def format_eeg(df: DataFrame) -> DataFrame:
    """An EEG table of five unnamed columns with the names of its channels and without R_AUX; raises for another width."""
    if len(df.columns) != len(CHANNELS["EEG"]):
        raise SourceError(f"an EEG table has {len(CHANNELS['EEG'])} columns, this one {len(df.columns)}")
    return df.toDF(*CHANNELS["EEG"]).drop("R_AUX")


def read_all_sessions(spark: SparkSession, folder: str, modalities: list[str]) -> dict[str, DataFrame]:
    """The Parquet tables `<modality>_all_sessions` of a folder that are there; those that are not are left out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    paths = {m: f"{folder.rstrip('/')}/{m.lower()}_all_sessions" for m in modalities}
    return {m: spark.read.parquet(p) for m, p in paths.items() if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))}


def read_yoga(spark: SparkSession, path: str) -> DataFrame:
    """The schedule of yoga poses, a CSV of poses and seconds: (pose, seconds)."""
    return spark.read.option("header", True).schema("pose string, seconds double").csv(path)


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """Event logs `<log_key>_events.csv` as (log_key, marker, start_time, end_time, category, metadata, duration).

    Yoga poses start two minutes earlier than noted; the duration is the one noted."""
    df = spark.read.option("header", True).schema(LOG_CSV).csv(path)
    key = F.regexp_replace(F.col("_metadata.file_name"), r"_events\.csv$", "")
    start = F.when(F.col("Category") == "Yoga Poses", F.col("Start") - 120).otherwise(F.col("Start"))
    return df.select(key.alias("log_key"), F.col("Marker").alias("marker"), start.alias("start_time"), F.col("End").alias("end_time"), F.col("Category").alias("category"), F.col("Metadata").alias("metadata"), (F.col("End") - F.col("Start")).alias("duration"))


def read_raw_log(spark: SparkSession, path: str, session: int = 0) -> DataFrame:
    """Raw logs of lines `<unix seconds>,<content>`: (log_key, session, line_no, ts, content), lines in file order.

    Line numbers come from the text reader's order within a file split, so they increase along a file."""
    df = spark.read.text(path).select(file_stem().alias("log_key"), "value", F.monotonically_increasing_id().alias("line_no"))
    parts = F.split("value", ",", 2)
    return df.where(F.size(parts) == 2).select("log_key", F.lit(session).alias("session"), "line_no", parts[0].try_cast("double").alias("ts"), F.replace(parts[1], F.lit(TYPO[0]), F.lit(TYPO[1])).alias("content"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
