"""Files: response logs by benchmark, registries, metadata, embeddings, caches, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the registries, and what trace files end in.
REGISTRIES = ["subjects.parquet", "items.parquet", "benchmarks.parquet"]
TRACES = "_traces.parquet"

RESPONSES = T.StructType([T.StructField(n, t) for n, t in [("subject_id", T.StringType()), ("item_id", T.StringType()), ("benchmark_id", T.StringType()), ("trial", T.LongType()), ("test_condition", T.StringType()), ("response", T.DoubleType()), ("correct_answer", T.StringType())]])
MODEL_INFO = "name string, organization string, params double, release_date double, family string, macro_family string"
BENCHMARK_INFO = "benchmark string, topic string, age double, has_conditions int, conditions string"


def list_response_files(spark: SparkSession, folder: str) -> list[str]:
    """Sorted paths of *.parquet that are neither registries nor traces, by whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found)
    return [f"{folder}/{n}" for n in names if n.endswith(".parquet") and n not in REGISTRIES and not n.endswith(TRACES)]


def load_responses(spark: SparkSession, folder: str, benchmarks: list[str] | None = None, most: int | None = None, drop_null: bool = True) -> DataFrame:
    """The log, joined to its registries. most: at most so many rows of each benchmark, the first by hash."""
    from responsa.functions.keys import order_hash
    from responsa.functions.normalize import condition, subject_card

    paths = [p for p in list_response_files(spark, folder) if benchmarks is None or p.rsplit("/", 1)[1][:-8] in benchmarks]
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    log = None
    for p in paths:
        one = spark.read.parquet(p)
        log = one if log is None else log.unionByName(one, allowMissingColumns=True)
    if log is None:
        log = spark.createDataFrame([], RESPONSES)
    if most:
        key = F.concat_ws(":", "benchmark_id", "subject_id", "item_id", "trial", "test_condition")
        log = log.withColumn("_r", F.row_number().over(Window.partitionBy("benchmark_id").orderBy(order_hash(key)))).filter(F.col("_r") <= most).drop("_r")
    s = read("subjects")
    fields = {label: F.col(c) for c, label in (("provider", "Organization"), ("params", "Parameters"), ("release_date", "Released"), ("family", "Family")) if c in s.columns}
    s = s.select(F.col("subject_id").cast("string"), subject_card(F.col("display_name"), F.col("subject_id").cast("string"), **fields).alias("card"))
    items = read("items").select(F.col("item_id").cast("string"), F.col("content").alias("item_content"))
    out = log.withColumns({c: F.col(c).cast("string") for c in ("subject_id", "item_id", "benchmark_id")}).join(s, "subject_id", "left").join(items, "item_id", "left")
    out = out.select("subject_id", "item_id", F.col("benchmark_id").alias("benchmark"), condition(F.col("test_condition")).alias("condition"), F.coalesce("card", F.concat(F.lit("Name: "), "subject_id")).alias("subject_content"), F.coalesce("item_content", F.lit("")).alias("item_content"), F.expr("try_cast(response as double)").alias("label"), "trial", *(c for c in ("correct_answer",) if c in log.columns))
    return out.na.drop(subset=["label"]) if drop_null else out


def load_metadata(spark: SparkSession, model_info: str, benchmark_info: str) -> tuple[DataFrame, DataFrame]:
    """Both CSV files, with their schemas; a missing file is an error. Conditions become a map."""
    read = lambda path, schema: spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", escape='"')
    b = read(benchmark_info, BENCHMARK_INFO)
    return read(model_info, MODEL_INFO), b.withColumn("conditions", F.from_json("conditions", "map<string,string>"))


def read_vectors(spark: SparkSession, path: str, key: str, vector: str = "embedding") -> DataFrame:
    """key, embedding (floats); vectors of other sizes than the first one's are an error."""
    df = spark.read.parquet(path).select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<float>").alias("embedding"))
    sizes = df.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"vectors of {sizes.a} and {sizes.b} numbers")
    return df


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("key", F.col("embedding").cast("array<float>")).write.parquet(path)


def latest(cache: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An append-only cache read so that the last row of each key counts."""
    return cache.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def samples_to_json(samples: Column) -> Column:
    return F.to_json(samples)


def samples_from_json(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def save_state(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """A fitted state: one table each, with a version that load_state checks."""
    for name, df in tables.items():
        df.withColumn("_version", F.lit(version)).write.parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, names: list[str], version: int = 1) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        if df.filter(F.col("_version") != version).limit(1).count():
            raise ValueError(f"{name}: another version")
        out[name] = df.drop("_version")
    return out
