"""Pluggable scorer: any function of a feature batch, run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# features of a batch -> (scores, contributions with one column per feature)
Model = Callable[[pd.DataFrame], tuple[pd.Series, pd.DataFrame]]


def score_with(
    df: DataFrame, model: Model, features: Sequence[str], id_col: str = "request_id"
) -> DataFrame:
    """(id, risk_score, risk_components) from a user model; scores are clipped."""
    names = list(features)
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("risk_score", T.DoubleType()),
            T.StructField("risk_components", T.MapType(T.StringType(), T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score, parts = model(batch[names])
            yield pd.DataFrame(
                {
                    id_col: batch[id_col],
                    "risk_score": score.clip(0.0, 1.0),
                    "risk_components": parts.to_dict("records"),
                }
            )

    return df.select(id_col, *names).mapInPandas(run, schema)
