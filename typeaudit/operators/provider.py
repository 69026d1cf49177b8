"""Plug-in point for a user's own advice provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ANSWER_SCHEMA = "request_id string, diagnosis string, model_source string, suggested_refactor string, error_kind string"

# Maps a batch of requests to answers; a failed request sets `error_kind`.
Provider = Callable[[pd.DataFrame], pd.DataFrame]


def ask(requests: DataFrame, provider: Provider) -> DataFrame:
    """Answers of ``provider`` for all ``requests``, batch by batch on the executors.

    The provider sees ``request_id, rule, type_name, severity, message, prompt``. Write the
    answers out before using them twice: a lost executor asks the provider again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider(batch)

    seen = requests.select("request_id", "rule", "type_name", "severity", "message", "prompt")
    return seen.mapInPandas(run, ANSWER_SCHEMA)
