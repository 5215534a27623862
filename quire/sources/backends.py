"""Engines that the library doesn't bring along, by name: OCR and embeddings.

A backend is a plain function that workers call on batches; equal inputs are given to it
once, and its failures are values of their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quire.operators.chunking import normalized


@dataclass
class Backends:
    """On the driver. An OCR backend takes (image, language) and gives text; an embedding backend takes
    texts and gives a vector of its dimensions for each."""

    ocr: dict[str, tuple[tuple[str, ...], Callable[[bytes, str], str]]] = field(default_factory=dict)
    embedding: dict[str, tuple[int, Callable[[list[str]], Sequence[Sequence[float]]]]] = field(default_factory=dict)

    def add_ocr(self, name: str, languages: Sequence[str], read: Callable[[bytes, str], str]) -> None:
        if not name.strip() or not languages:
            raise ValueError("an OCR backend has a name and a language at least")
        self.ocr[name] = (tuple(languages), read)

    def add_embedding(self, name: str, dimensions: int, embed: Callable[[list[str]], Sequence[Sequence[float]]]) -> None:
        if not name.strip() or dimensions <= 0:
            raise ValueError("an embedding backend has a name and a dimension at least")
        self.embedding[name] = (dimensions, embed)

    def languages(self, name: str) -> tuple[str, ...] | None:
        """In order; None if there is no such backend."""
        return tuple(sorted(self.ocr[name][0])) if name in self.ocr else None

    def supports(self, name: str, language: str) -> bool:
        return language in (self.languages(name) or ())

    def names(self) -> list[str]:
        return sorted(self.ocr)


def recognised(images: DataFrame, backends: Backends, name: str, language: str) -> DataFrame:
    """The rows of images (data binary, and others) with text and ocr_error. Images of the same bytes are read once; a null image has
    neither. An unknown backend or language raises before any plan is made."""
    if not backends.supports(name, language):
        raise ValueError(f"backend {name!r} doesn't read {language!r}")
    read = backends.ocr[name][1]

    def one(data: bytes) -> tuple[str | None, str | None]:
        try:
            return read(bytes(data), language), None
        except Exception as e:  # noqa: BLE001  an engine's failure is its row's
            return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [one(d) for d in rows["data"]]
            yield pd.DataFrame({"image_key": rows["image_key"], "text": [t for t, _ in found], "ocr_error": [e for _, e in found]})

    keyed = images.withColumn("image_key", F.sha2("data", 256))
    once = keyed.where("data IS NOT NULL").groupBy("image_key").agg(F.first("data").alias("data"))
    read_once = once.mapInPandas(run, "image_key string, text string, ocr_error string")
    return keyed.join(read_once, "image_key", "left").drop("image_key")


def embedded(texts: DataFrame, backends: Backends, name: str, column: str = "text", unit: bool = True, most: int = 256) -> DataFrame:
    """The rows with embedding array<double>, of length 1 if ``unit``; null texts have none. A backend that
    gives another number of vectors or of components is an error of the job."""
    dimensions, embed = backends.embedding[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            asked = rows["asked"].tolist()
            out: list = [None] * len(asked)
            there = [k for k, t in enumerate(asked) if t is not None]
            for at in range(0, len(there), most):
                part = there[at : at + most]
                vectors = [[float(x) for x in v] for v in embed([asked[k] for k in part])]
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError(f"backend {name!r} must give {dimensions} numbers for each text")
                for k, v in zip(part, vectors, strict=True):
                    out[k] = v
            yield pd.DataFrame({**{c: rows[c] for c in rows.columns if c != "asked"}, "embedding": out})

    schema = StructType([*texts.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    found = texts.select("*", F.col(column).alias("asked")).mapInPandas(run, schema)
    return found.withColumn("embedding", normalized(F.col("embedding"))) if unit else found
