"""Asking once: what the provider sees in a first run, after a failure, and in later runs."""

import os

import pandas as pd
import pytest

from typeaudit.operators import ledger

COLUMNS = "request_id string, rule string, type_name string, severity string, message string, prompt string"


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "ledger"), str(tmp_path / "calls")


@pytest.fixture
def asked(spark):
    """Forty prompts, each of three requests; one request without prompt and one with an empty one."""
    rows = [(f"r{i:03d}", "R", None, "info", "m", f"prompt {i % 40}") for i in range(120)]
    rows += [("none", "R", None, "info", "m", None), ("empty", "R", None, "info", "m", "")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def provider(calls, broken=(), failing=(), silent=()):
    """Notes what it was asked; raises, answers with an error, or says nothing for some prompts."""

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        prompts = batch["prompt"].fillna("null")
        if prompts.isin(broken).any():
            raise RuntimeError("provider is gone")
        for prompt in prompts:
            with open(f"{calls}/{prompt}", "a") as note:
                note.write("x")
        found = pd.DataFrame(
            {
                "request_id": batch["request_id"], "diagnosis": "d", "model_source": "test", "suggested_refactor": "to " + prompts,
                "error_kind": [("timeout" if p in failing else None) for p in prompts],
            }
        )
        return found[~prompts.isin(silent).to_numpy()]

    return answer


def noted(calls):
    return {name: os.path.getsize(f"{calls}/{name}") for name in os.listdir(calls)}


def answered(rows):
    return {r.request_id: (r.suggested_refactor, r.error_kind) for r in rows.collect()}


def test_equal_prompts_are_asked_once_and_never_again(spark, asked, folders):
    path, calls = folders
    want = {f"r{i:03d}": (f"to prompt {i % 40}", None) for i in range(120)} | {"none": ("to null", None), "empty": ("to ", None)}
    named = asked.fillna({"prompt": "null"}).where("prompt <> ''")
    assert answered(ledger.ask_once(named, provider(calls), path, tasks=3, batch_prompts=4)) == {k: v for k, v in want.items() if k != "empty"}
    assert noted(calls) == {f"prompt {i}": 1 for i in range(40)} | {"null": 1}
    assert answered(ledger.ask_once(named, provider(calls, broken=["null"]), path)) == {k: v for k, v in want.items() if k != "empty"}
    assert set(noted(calls).values()) == {1}


def test_a_missing_prompt_is_not_the_empty_one(spark, asked, folders):
    path, _ = folders
    rows = asked.where("request_id in ('none', 'empty')")
    echo = lambda batch: pd.DataFrame(
        {"request_id": batch["request_id"], "diagnosis": "d", "model_source": "t", "suggested_refactor": batch["request_id"], "error_kind": None}
    )
    assert answered(ledger.ask_once(rows, echo, path)) == {"none": ("none", None), "empty": ("empty", None)}


def test_a_failure_in_the_middle_loses_no_answer(spark, asked, folders):
    path, calls = folders
    rows = asked.where("prompt like 'prompt%'")
    with pytest.raises(Exception, match="provider is gone"):
        ledger.ask_once(rows, provider(calls, broken=["prompt 7"]), path, tasks=1, batch_prompts=1)
    before = noted(calls)
    assert before and "prompt 7" not in before
    assert ledger.answers(spark, path).count() == len(before)
    found = answered(ledger.ask_once(rows, provider(calls), path, tasks=2, batch_prompts=5))
    assert found == {f"r{i:03d}": (f"to prompt {i % 40}", None) for i in range(120)}
    assert noted(calls) == {f"prompt {i}": 1 for i in range(40)}


def test_errors_and_silence_are_asked_again(spark, asked, folders):
    path, calls = folders
    rows = asked.where("prompt in ('prompt 1', 'prompt 2', 'prompt 3')")
    first = answered(ledger.ask_once(rows, provider(calls, failing=["prompt 1"], silent=["prompt 2"]), path))
    assert first["r001"] == ("to prompt 1", "timeout") and "r002" not in first and first["r003"] == ("to prompt 3", None)
    second = answered(ledger.ask_once(rows, provider(calls), path))
    assert second == {f"r{i:03d}": (f"to prompt {i % 40}", None) for i in range(120) if i % 40 in (1, 2, 3)}
    assert noted(calls) == {"prompt 1": 2, "prompt 2": 2, "prompt 3": 1}


def test_no_requests(spark, asked, folders):
    path, calls = folders
    assert ledger.ask_once(asked.where("false"), provider(calls), path).count() == 0 and not noted(calls)
