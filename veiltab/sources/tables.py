"""Tables from CSV, ZIP and Parquet files with JSON metadata, and their sinks."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.domain import Domain
from ..operators.infer import infer, value_counts
from ..operators.synth import independent
from ..plans.tables import shared_dir


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By extension: .csv, .tsv, .zip (its first .csv), .parquet."""
    low = path.lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".zip"):
        return load(spark, unzipped(spark, path), schema)
    if not low.endswith((".csv", ".tsv")):
        raise ValueError("only .csv, .tsv, .zip and .parquet files are read")
    reader = spark.read.option("header", True).option("encoding", "utf-8").option("sep", "\t" if low.endswith(".tsv") else ",")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def unzipped(spark: SparkSession, path: str) -> str:
    """Writes the first .csv member of an uploaded archive to the shared folder. An upload is one file of bounded size."""
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
        if name is None:
            raise ValueError("the archive holds no .csv file")
        text = z.read(name)
    out = f"{shared_dir(spark)}/{abs(hash((path, len(text))))}.csv"
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text))
    finally:
        stream.close()
    return out


def metadata(df: DataFrame) -> tuple[dict, dict]:
    """(domain, info) as the JSON sidecars hold them."""
    domain, found = {}, infer(df)
    for c in found:
        if c.kind == "categorical":
            counts = {r["value"]: r["n"] for r in value_counts(df, c.name, None).collect()}  # the domain has every category
            domain[c.name] = {"type": c.kind, "size": c.size, "categories": list(counts), "value_counts": counts}
        else:
            low, high, mean, std = df.agg(F.min(c.name), F.max(c.name), F.avg(c.name), F.stddev_samp(c.name)).first()
            domain[c.name] = {"type": c.kind, "size": c.size, "min": low, "max": high, "mean": mean, "std": std}
    info = {"num_columns": [c.name for c in found if c.kind == "numerical"], "cat_columns": [c.name for c in found if c.kind == "categorical"], "rows": found[0].rows if found else 0, "report": {c.name: c.reason for c in found}}
    return domain, info


def save_metadata(path: str, domain: dict, info: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"domain": domain, "info": info}, f, default=str)


def load_with_domain(spark: SparkSession, path: str, domain_path: str) -> tuple[DataFrame, Domain]:
    """A coded table and its domain from a JSON object of sizes; columns outside the domain are left out."""
    with open(domain_path, encoding="utf-8") as f:
        domain = Domain.of(json.load(f))
    return load(spark, path).select(*domain.attrs), domain


def save_csv(df: DataFrame, path: str) -> None:
    """One CSV file: for small results; large ones keep their partitions."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def random_table(spark: SparkSession, domain: Domain, n: int, seed: int = 0) -> DataFrame:
    return independent(spark, n, dict(zip(domain.attrs, domain.shape, strict=True)), seed).drop("row_id")


# Tables by name, and what is kept between runs.

_SAMPLES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_sample(name: str, make: Callable[[SparkSession], DataFrame]) -> None:
    _SAMPLES[name.casefold()] = make


def sample(spark: SparkSession, name: str) -> DataFrame:
    """A registered table; a KeyError names those there are."""
    if name.casefold() not in _SAMPLES:
        raise KeyError(f"no sample table {name!r}; there are: {', '.join(sorted(_SAMPLES)) or 'none'}")
    return _SAMPLES[name.casefold()](spark)


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table of a result in folder, by what it was made from (dataset, method, epsilon, preprocessing, ...);
    made and written if it is not there yet."""
    digest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{digest}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_parts(df: DataFrame, path: str, num_columns: Sequence[str], cat_columns: Sequence[str]) -> None:
    """Decoded records as two Parquet tables with the same row ids: the numerical and the categorical columns."""
    rows = df if "row_id" in df.columns else df.withColumn("row_id", F.monotonically_increasing_id())
    for name, columns in (("num", num_columns), ("cat", cat_columns)):
        rows.select("row_id", *columns).write.mode("overwrite").parquet(f"{path}/{name}")


def save_tsv(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """Tab-separated part files with a header, as the cluster makes them, and the metadata as one JSON line beside them."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    spark = df.sparkSession
    kinds = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
    spark.range(1).select(F.lit(json.dumps({"columns": kinds, **(meta or {})}, default=str)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def load_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A table of save_tsv() with the types that its metadata states."""
    meta = json.loads(spark.read.text(f"{path}.meta").first()["value"])
    schema = T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["type"])) for c in meta["columns"]])
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path), meta
