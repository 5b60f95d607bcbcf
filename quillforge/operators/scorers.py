"""The seam for external scorers: Arrow batches in, a struct of evidence out. Models load once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "score_vlm double, score_ocr double, ocr_detected string"


def fake_scorer() -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    """A scorer without a model: deterministic evidence from the two texts, for tests and dry runs."""

    def score(target: pd.Series, found: pd.Series) -> pd.DataFrame:
        a, b = target.fillna("").str.len(), found.fillna("").str.len()
        top = pd.concat([a, b], axis=1).max(axis=1).clip(lower=1)
        return pd.DataFrame({"score_vlm": 1 - (a - b).abs() / top, "score_ocr": (a == b).astype(float), "ocr_detected": found})

    return score


def scored(rows: DataFrame, target: Column, found: Column, load: Callable = fake_scorer) -> DataFrame:
    """Rows with an ``evidence`` struct from a scorer that ``load`` makes on the worker."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        score = load()
        for a, b in parts:
            yield score(a, b)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return rows.withColumn("evidence", F.pandas_udf(run, EVIDENCE)(target, found))


def phrases(items: DataFrame, load: Callable, schema: str) -> DataFrame:
    """N rows in, N rows out, by batches: the shape of a text generator's back end."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for part in parts:
            yield generate(part)

    return items.mapInPandas(run, schema)
