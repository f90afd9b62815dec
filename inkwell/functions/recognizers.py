"""Recognisers: pluggable columns from an image to its text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered


class Recognizer(Protocol):
    def __call__(self, lines: DataFrame, image: str, order: list[str]) -> DataFrame:
        """``lines`` with ocr_text."""


def empty(lines: DataFrame, image: str, order: list[str]) -> DataFrame:
    return lines.withColumn("ocr_text", F.lit(""))


def demo(texts: list[str]) -> Recognizer:
    """The texts in scan order; the last one repeats."""

    def run(lines: DataFrame, image: str, order: list[str]) -> DataFrame:
        at = F.least(F.col("_rank") + 1, F.lit(len(texts))).cast("int")
        return numbered(lines, order, "_rank").withColumn("ocr_text", F.element_at(F.array(*[F.lit(t) for t in texts]), at)).drop("_rank")

    return run


def model(load: Callable[[], Callable[[list], list[str]]]) -> Recognizer:
    """A model that each worker loads once and that reads a batch of images at a time."""

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        read = load()
        for images in batches:
            yield pd.Series(read(images.tolist()))

    def run(lines: DataFrame, image: str, order: list[str]) -> DataFrame:
        text: Column = predict(F.col(image))
        return lines.withColumn("ocr_text", text)

    return run
