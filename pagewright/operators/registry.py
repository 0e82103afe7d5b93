"""Small dimensions: models and providers, and the plug-in points by which work is done in Python.

The registries are tables of fixed size that belong to the program, so their joins are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The models known by default: id, provider, name, architecture, task, file, bytes, SHA-256, devices. All are ONNX
# files that are fetched by URL and ready; the addresses are the operator's to give.
MODELS = [
    ("rapidocr_onnx", "rapidocr", "RapidOCR Mobile PP-OCRv4 ONNX", "PP-OCRv4", "ocr", "ch_PP-OCRv4_rec_infer.onnx", 10857312, "4d7b7e05f6bf79e19d71c4c8d5d9a0937a0753ffc5bc91238612140d344d5c90", "cpu,cuda"),
    ("rtdetr_doclaynet", "rtdetr_layout", "RT-DETR DocLayNet Layout Analyzer", "RT-DETR", "layout", "rtdetr_doclaynet.onnx", 44281920, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "cpu,cuda,openvino"),
    ("slanet_table", "slanet_table", "SLANet Table Structure Recognizer", "SLANet", "table", "slanet_table.onnx", 18492000, "a665a45920422f9d417e4867efdc4fb8a04a1f3fff1fa07e998e86f7f7a27ae3", "cpu,cuda"),
    ("easyocr", "easyocr_engine", "EasyOCR (Accurate)", "CRNN", "ocr", "easyocr.onnx", 85000000, None, "cpu,cuda"),
    ("tesseract", "tesseract_engine", "Tesseract OCR (Legacy)", "LSTM", "ocr", "eng.traineddata", 30000000, None, "cpu"),
    ("onnxtr", "onnxtr_engine", "OnnxTR (Transformer OCR)", "Transformer", "ocr", "onnxtr.onnx", 210000000, None, "cpu,cuda"),
    ("nemotron_ocr", "nemotron_engine", "NVIDIA Nemotron-OCR (Heavy)", "Nemotron", "ocr", "nemotron.onnx", 4500000000, None, "cpu,cuda"),
    ("docling_heron", "docling_engine", "Docling Heron Layout (Heavy)", "Heron", "layout", "heron.onnx", 1200000000, None, "cpu,cuda"),
    ("tableformerv2", "tableformer_engine", "TableFormerV2 (Transformer)", "TableFormer", "table", "tableformerv2.onnx", 340000000, None, "cpu,cuda"),
    ("codeformulav2", "formula_engine", "CodeFormulaV2 (Accurate)", "CodeFormula", "formula", "codeformulav2.onnx", 110000000, None, "cpu,cuda"),
]
SPEC = "model_id string, provider string, model_name string, architecture string, task string, filename string, size_bytes long, checksum_sha256 string, devices string"
READY = "ready"
INSTALLED_BYTES = 1024


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, SPEC).withColumn("state", F.lit(READY))


def of_task(m: DataFrame, task: str | None = None) -> DataFrame:
    return m if task is None else m.where(F.col("task") == task)


def registered(m: DataFrame, spec: DataFrame) -> DataFrame:
    """The registry with further models, which replace those of the same id."""
    return m.join(F.broadcast(spec.select("model_id")), "model_id", "left_anti").unionByName(spec, allowMissingColumns=True)


def with_state(m: DataFrame, model_id: str, state: str) -> DataFrame:
    return m.withColumn("state", F.when(F.col("model_id") == model_id, state).otherwise(F.col("state")))


def store_name(model_id: Column) -> Column:
    """A model's folder in a store: slashes and colons of its id become underscores."""
    return F.regexp_replace(model_id, "[/:]", "_")


def write_store(m: DataFrame, path: str) -> None:
    """The specs as JSON below path, a folder for each task and model."""
    m.withColumn("folder", store_name(F.col("model_id"))).withColumn("of", F.col("task")).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("of", "folder").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The models of a store; specs that can't be read are left out."""
    return spark.read.schema(SPEC + ", state string").option("mode", "DROPMALFORMED").json(path).where("model_id is not null")


def without(m: DataFrame, model_id: str) -> DataFrame:
    return m.where(F.col("model_id") != model_id)


def installed(files: DataFrame) -> DataFrame:
    """Model files (model, content) -> size and whether the model counts as installed."""
    g = files.groupBy("model").agg(F.sum(F.length("content")).alias("bytes"))
    return g.withColumn("installed", F.col("bytes") > INSTALLED_BYTES)


def verified(content: Column, expected: Column) -> Column:
    return F.coalesce(F.sha2(content, 256) == F.lower(expected), F.lit(False))


@dataclass(frozen=True)
class Provider:
    """A plug-in: make() runs once in a worker and gives a function from a batch to a batch of `schema`."""

    name: str
    task: str
    schema: str
    make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    remote: bool = False
    available: bool = True


def made(kinds: dict[str, Callable[..., Provider]], kind: str, settings: dict) -> Provider:
    """A provider of a known kind with its settings, which are checked before it is made."""
    if kind not in kinds:
        raise LookupError(f"unknown kind of provider: {kind}")
    remote = settings.get("remote", False)
    if remote and not settings.get("endpoint"):
        raise ValueError("a remote provider needs an endpoint")
    return kinds[kind](**settings)


def round_robin(place: Column, workers: int) -> Column:
    """The worker that does the item at a 0-based place."""
    return F.pmod(place, F.lit(workers)).cast("int")


class Registry:
    """Providers by task: the first available one, else the first; remote ones only if allowed."""

    def __init__(self) -> None:
        self._by_task: dict[str, list[Provider]] = {}

    def register(self, p: Provider) -> None:
        self._by_task.setdefault(p.task, []).append(p)

    def choose(self, task: str, name: str | None = None, allow_remote: bool = False) -> Provider:
        found = [p for p in self._by_task.get(task, []) if allow_remote or not p.remote]
        if name is not None:
            found = [p for p in found if p.name == name]
        if not found:
            raise LookupError(f"no provider for {task}")
        return next((p for p in found if p.available), found[0])


def applied(df: DataFrame, p: Provider) -> DataFrame:
    """The provider over all batches; what it loads is loaded once a worker's partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = p.make()
        for pdf in batches:
            yield f(pdf)

    return df.mapInPandas(run, p.schema)
