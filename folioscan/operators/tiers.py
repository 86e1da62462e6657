"""Choices by size: models by memory, batch sizes, workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Models, largest first, with the memory in MB from which each is chosen, and their download sizes.
MODELS = [("Qwen2.5-7B-Instruct", 8192, 16384, "~4.7 GB"), ("Qwen2.5-3B-Instruct", 8192, 8192, "~2.1 GB"), ("Qwen2.5-1.5B-Instruct", 8192, 0, "~1.1 GB")]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "name string, ctx_size int, ram_min_mb int, size_label string")


def model_for(machines: DataFrame, ram: str = "ram_mb") -> DataFrame:
    """machines with the largest model that fits; a range join against the three rows of models()."""
    tiers = F.broadcast(models(machines.sparkSession))
    fit = machines.join(tiers, F.col(ram) >= F.col("ram_min_mb"), "left")
    return fit.groupBy(*machines.columns).agg(F.max_by(F.struct("name", "size_label"), "ram_min_mb").alias("m")).select(*machines.columns, F.coalesce("m.name", F.lit(MODELS[-1][0])).alias("model"), F.coalesce("m.size_label", F.lit(MODELS[-1][3])).alias("size_label"))


def batch_size(available_mb: Column) -> Column:
    return F.when(available_mb.isNull() | (available_mb >= 4096), 64).when(available_mb >= 2048, 32).when(available_mb >= 1024, 16).when(available_mb >= 512, 8).otherwise(4)


def batch_sleep(available_mb: Column) -> Column:
    return F.when(available_mb.isNull() | (available_mb >= 1024), 0.0).when(available_mb >= 512, 0.05).otherwise(0.2)


def workers(documents: Column, cpus: Column, available_mb: Column) -> Column:
    """Parse workers that a single machine would run; Spark's own scheduling takes their place here."""
    base = F.least(cpus, F.greatest(documents, F.lit(1)))
    base = F.when(base > 2, base - 1).otherwise(base)
    most = F.when(available_mb.isNull(), base).when(available_mb < 2048, 2).when(available_mb < 4096, 3).when(available_mb < 8192, 6).otherwise(8)
    return F.greatest(F.lit(1), F.least(base, most, documents))


# In order, when a machine gets which backend, model file and device. A rule's provider is one that must be there.
BACKENDS = [
    ("platform = 'darwin' AND machine = 'arm64'", "onnx", "onnx/model_qint8_arm64.onnx", None),
    ("gpu = 'cuda' AND array_contains(providers, 'CUDAExecutionProvider')", "onnx", None, None),
    ("gpu = 'cuda'", "torch", None, "cuda"),
    ("gpu = 'rocm' AND array_contains(providers, 'ROCMExecutionProvider')", "onnx", None, None),
    ("gpu = 'rocm'", "torch", None, "cuda"),
    ("size(providers) > 0", "onnx", None, None),
    ("gpu = 'mps'", "torch", None, "mps"),
    ("true", "torch", None, "cpu"),
]
UNKNOWN_RAM_MB = 8192


def backends(machines: DataFrame) -> DataFrame:
    """machines (platform, machine, gpu, providers) with backend, model_file, device: those of the first rule that holds."""
    rows = machines.withColumn("providers", F.coalesce("providers", F.array().cast("array<string>")))
    choice = F.coalesce(*(F.when(F.expr(f"coalesce({test}, false)"), F.struct(F.lit(b).alias("backend"), F.lit(m).cast("string").alias("model_file"), F.lit(d).cast("string").alias("device"))) for test, b, m, d in BACKENDS))
    return rows.withColumn("_b", choice).select(*machines.columns, "_b.*")


def gpu_layers(platform: Column, machine: Column, gpu: Column) -> Column:
    """-1, all of a model's layers, with Metal or CUDA; else 0."""
    return F.when(((platform == "darwin") & (machine == "arm64")) | (gpu == "cuda"), -1).otherwise(0)


def known_ram(ram_mb: Column) -> Column:
    return F.coalesce(ram_mb, F.lit(UNKNOWN_RAM_MB))
