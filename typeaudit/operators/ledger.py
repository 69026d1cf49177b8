"""Asking a provider once for each distinct prompt, with a ledger that outlives failures.

The ledger is a folder of answers by prompt. A run asks only the prompts that have no good answer in it, each once however many
requests share it. A task writes the answers of a few prompts as soon as it has them, under a name made from these prompts and
with a rename, so a provider that fails in the middle loses none, and a task that is run again goes on behind what the first
attempt wrote.

Cases: a request without prompt is a prompt of its own kind (null), told apart from the empty one. What the provider leaves out, or
answers with an error, is asked again by the next run. Of several answers to a prompt a good one counts, then the least. Answers to
requests that were not asked are left out. Empty requests ask nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit.operators.provider import Provider
from typeaudit.sources import listing

ANSWERED = ["diagnosis", "model_source", "suggested_refactor", "error_kind"]
SCHEMA = ", ".join(f"{name} string" for name in ["prompt_key", *ANSWERED])
_ARROW = pa.schema([(name, pa.string()) for name in ["prompt_key", *ANSWERED]])
SEEN = ["request_id", "rule", "type_name", "severity", "message", "prompt"]
#: Prompts whose answers are written at once: what a failure may cost at most in a task.
BATCH_PROMPTS = 32


def prompt_key(prompt: Column) -> Column:
    return F.sha2(F.coalesce(F.concat(F.lit("+"), prompt), F.lit("-")), 256)


def answers(spark, ledger: str) -> DataFrame:
    """``prompt_key`` and the columns of ``ANSWERED``, once for each prompt that was answered, be it with an error."""
    system, folder = listing.opened(ledger)
    system.create_dir(folder, recursive=True)
    rows = spark.read.schema(SCHEMA).parquet(ledger)
    best = F.min(F.struct(F.col("error_kind").isNotNull().alias("failed"), *ANSWERED)).alias("best")
    return rows.groupBy("prompt_key").agg(best).select("prompt_key", *(F.col(f"best.{name}") for name in ANSWERED))


def _asked(batches: Iterator[pd.DataFrame], provider: Provider, ledger: str, size: int, run: str) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    system, folder = listing.opened(ledger)
    folder = folder.rstrip("/")
    held: list[pd.DataFrame] = []

    def settle(asked: pd.DataFrame) -> pd.DataFrame:
        # The name is the same for a task that is run again, and another one for a later run.
        name = hashlib.sha256("".join([run, *asked["prompt_key"]]).encode()).hexdigest()
        path = f"{folder}/{name}.parquet"
        if system.get_file_info(path).type == fs.FileType.File:
            return pd.DataFrame({"n_asked": [0]})
        found = provider(asked[SEEN].reset_index(drop=True))
        found = found.merge(asked[["request_id", "prompt_key"]], on="request_id")
        staged = f"{folder}/_staged-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as stream:
            pq.write_table(pa.Table.from_pandas(found[_ARROW.names], schema=_ARROW, preserve_index=False), stream)
        system.move(staged, path)
        return pd.DataFrame({"n_asked": [len(asked)]})

    for batch in batches:
        held.append(batch)
        waiting = pd.concat(held)
        while len(waiting) >= size:
            yield settle(waiting.iloc[:size])
            waiting = waiting.iloc[size:]
        held = [waiting]
    if held and len(held[0]):
        yield settle(held[0])


def open_prompts(requests: DataFrame, ledger: str) -> DataFrame:
    """One request, that of the least id, for each prompt without a good answer."""
    good = answers(requests.sparkSession, ledger).where("error_kind is null").select("prompt_key")
    keyed = requests.select(prompt_key(F.col("prompt")).alias("prompt_key"), F.struct(*SEEN).alias("seen"))
    # Requests that share a prompt collapse before the exchange.
    return keyed.groupBy("prompt_key").agg(F.min("seen").alias("seen")).join(good, "prompt_key", "left_anti").select("prompt_key", "seen.*")


def ask_once(requests: DataFrame, provider: Provider, ledger: str, tasks: int | None = None, batch_prompts: int = BATCH_PROMPTS) -> DataFrame:
    """Answers of all ``requests`` that the ledger can answer, after the provider was asked for the prompts it could not.

    ``ledger`` is a folder that every executor can reach. ``tasks`` is how many ask at a time. Result: ``request_id`` and the
    columns of ``ANSWERED``.
    """
    spark = requests.sparkSession
    count = tasks or spark.sparkContext.defaultParallelism
    # One order for every attempt, so that a second one names its batches as the first one did.
    placed = open_prompts(requests, ledger).repartition(count, "prompt_key").sortWithinPartitions("prompt_key")
    run = uuid.uuid4().hex
    placed.mapInPandas(lambda it: _asked(it, provider, ledger, batch_prompts, run), "n_asked long").agg(F.sum("n_asked")).collect()
    known = answers(spark, ledger)
    keyed = requests.select("request_id", prompt_key(F.col("prompt")).alias("prompt_key"))
    return keyed.join(known, "prompt_key").select("request_id", *ANSWERED)
