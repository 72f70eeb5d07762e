"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "array<struct<type:string,timestamp:bigint,message:string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def console_logs(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """One row for each entry of a JSON array that has a type, a time and a message; broken JSON has none."""
    return df.select(*keys, F.inline(F.from_json(json_col, LOG)).alias("log_type", "timestamp", "message")).dropna(subset=["log_type", "timestamp", "message"])


def json_line(pretty: bool = False, *columns: Column | str) -> Column:
    """A JSON object of the columns, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Queues and logs are appended to a folder."""
    df.write.mode("append").format(fmt).save(path)


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _number(x: Column) -> Column:
    """Whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def exposition_text(metrics: DataFrame, families: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """Metrics (metric, label, value, and of histograms bound, part) as lines of the text exposition format, with HELP and TYPE: (metric, rank, line).

    families: metric -> (type, help, name of its label or null). part of a histogram's row is bucket (bound: null for all), sum or count. rank orders a family's lines.
    """
    spark = metrics.sparkSession
    told = spark.createDataFrame([(k, t, h, n) for k, (t, h, n) in families.items()], "metric string, type string, help string, name string")
    heads = told.select("metric", F.inline(F.array(F.struct(F.lit("0").alias("rank"), F.concat(F.lit("# HELP "), "metric", F.lit(" "), "help").alias("line")), F.struct(F.lit("1").alias("rank"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "type").alias("line")))))
    cols = set(metrics.columns)
    bound, part = (F.col(c) if c in cols else F.lit(None).cast(t) for c, t in (("bound", "double"), ("part", "string")))
    rows = metrics.withColumn("_bound", bound).withColumn("_part", part).join(F.broadcast(told), "metric")
    own = F.when(F.col("name").isNotNull() & F.col("label").isNotNull(), F.concat("name", F.lit('="'), _escaped(F.col("label")), F.lit('"')))
    le = F.when(F.col("_part") == "bucket", F.concat(F.lit('le="'), F.coalesce(F.col("_bound").cast("string"), F.lit("+Inf")), F.lit('"')))
    labels = F.concat_ws(",", own, le)
    name = F.concat("metric", F.when(F.col("_part").isNotNull(), F.concat(F.lit("_"), "_part")).otherwise(""))
    line = F.concat(name, F.when(labels != "", F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), _number(F.col("value")))
    rank = F.concat_ws("|", F.lit("2"), F.coalesce("label", F.lit("")), F.element_at(F.create_map(*[F.lit(x) for x in ("bucket", "0", "sum", "1", "count", "2")]), F.coalesce("_part", F.lit("bucket"))), F.lpad(F.coalesce(F.format_string("%.6f", "_bound"), F.lit("9" * 20)), 20, "0"))
    present = heads.join(metrics.select("metric").distinct(), "metric", "left_semi")
    return present.union(rows.select("metric", rank, line))


def exposition(metrics: DataFrame, labels: dict[str, str | None]) -> DataFrame:
    """Metrics (metric, label, value) as lines of the text exposition format."""
    name = F.create_map(*[x for k, v in labels.items() if v for x in (F.lit(k), F.lit(v))])[F.col("metric")] if any(labels.values()) else F.lit(None).cast("string")
    head = F.when(name.isNotNull() & F.col("label").isNotNull(), F.concat(F.col("metric"), F.lit("{"), name, F.lit('="'), F.col("label"), F.lit('"}'))).otherwise(F.col("metric"))
    return metrics.select(F.concat(head, F.lit(" "), F.col("value").cast("string")).alias("line"))
