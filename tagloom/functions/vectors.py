"""Vector codecs, embedders, and functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from . import structure
from .terms import hashed_words


@pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes; a trailing partial number is left out."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


@pandas_udf(T.BinaryType())
def vector_to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


class Embedder(Protocol):
    """What an embedding model has to offer."""

    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedTerms:
    """Built-in embedder: hashed term counts with signs, normalised. Needs no weights."""

    def __init__(self, dim: int = 64):
        self.model_id, self.dim = f"hashed-{dim}", dim

    def embed(self, texts: list[str]) -> np.ndarray:
        row, h = hashed_words(texts)
        at = row * self.dim + h % self.dim
        out = np.bincount(at, np.where(h >> 16 & 1, 1.0, -1.0), len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embedding_text(title: Column, abstract: Column) -> Column:
    """``title. abstract`` if both are there."""
    return F.concat(title, F.lit(". "), abstract)


def tag_text(name: Column, definition: Column) -> Column:
    return F.concat(name, F.lit(": "), definition)


def embed(df: DataFrame, text_col: str, embedder: Embedder, known: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """doc_id, model_id, vector for rows with text; those that ``known`` has for the model are left out."""
    todo = df.where(F.col(text_col).isNotNull()).select("doc_id", F.col(text_col).alias("text"))
    if known is not None:
        todo = todo.join(known.where(F.col("model_id") == embedder.model_id).select("doc_id"), "doc_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"doc_id": part["doc_id"], "model_id": embedder.model_id, "vector": list(embedder.embed(part["text"].tolist()))})

    return todo.mapInPandas(run, "doc_id bigint, model_id string, vector array<float>")


_BLOCK = T.StructType(
    [
        T.StructField("n", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
    ]
)


@udtf(returnType=_BLOCK)
class DescriptionBlocks:
    """Blocks of one description, for LATERAL joins."""

    def eval(self, text: str):
        yield from structure.description_rows(text)


@udtf(returnType=_BLOCK)
class ClaimBlocks:
    """Claims of one text, for LATERAL joins; n counts the blocks, those before the first number are block 0."""

    def eval(self, text: str):
        for c in structure.claims(text):
            yield c.block, "claim", c.label, c.start, c.stop


@udtf(returnType="claim bigint, start int, stop int, ref bigint, depends boolean")
class ClaimReferences:
    """Links between the claims of one text, for LATERAL joins."""

    def eval(self, text: str):
        yield from structure.reference_rows(text)


@udtf(returnType="claim bigint, is_independent boolean, depth int, base bigint")
class ClaimTree:
    """Depths of the claims of one text, for LATERAL joins."""

    def eval(self, text: str):
        yield from structure.tree_rows(text)


def register(spark: SparkSession) -> None:
    """SQL names of the engine's functions."""
    spark.udtf.register("description_blocks", DescriptionBlocks)
    spark.udtf.register("claim_blocks", ClaimBlocks)
    spark.udtf.register("claim_references", ClaimReferences)
    spark.udtf.register("claim_tree", ClaimTree)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pub_key(c STRING, n STRING) RETURNS STRING RETURN concat(c, n)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vector_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE "
        "RETURN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION l2_normalise(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN "
        "transform(v, x -> x / if(aggregate(v, CAST(0 AS DOUBLE), (s, y) -> s + y * y) > 0, sqrt(aggregate(v, CAST(0 AS DOUBLE), (s, y) -> s + y * y)), 1))"
    )
    parts = r"upper(regexp_extract(trim(raw), '^([A-Za-z]+)', 1))", r"translate(regexp_extract(trim(raw), '^[A-Za-z]+([\\s\\S]*)$', 1), ' ./,', '')"
    number = rf"regexp_extract({parts[1]}, '^(\\d+)([A-Za-z]\\d*)?$', 1)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION publication_key(raw STRING) RETURNS STRING "
        f"RETURN CASE WHEN {parts[0]} <> '' AND {number} <> '' THEN concat({parts[0]}, {number}) END"
    )
