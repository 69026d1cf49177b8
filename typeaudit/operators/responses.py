"""Answers of chat and content endpoints as tables: text extraction, error triage, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeaudit.functions import text as tx

INVALID_CONFIGURATION = "invalidConfiguration"
REQUEST_FAILED = "requestFailed"
TIMEOUT = "timeout"
INVALID_RESPONSE = "invalidResponse"
LOCAL_UNAVAILABLE = "localUnavailable"

# Retry limit, and the marks of a transient failure in an error message.
MAX_ATTEMPTS = 3
TRANSIENT_STATUS = ["HTTP 429", "HTTP 503"]
TRANSIENT_NETWORK = [
    "URL_ERROR -1001", "URL_ERROR -1003", "URL_ERROR -1004", "URL_ERROR -1005", "URL_ERROR -1009", "URL_ERROR -1200",
]

# Where each kind of body keeps its text, and the labels of its advice.
CHAT_TEXT = "$.choices[0].message.content"
CONTENT_TEXT = "$.candidates[0].content.parts[0].text"
CHAT_DIAGNOSIS = "Local analysis generated by Ollama."
CHAT_SOURCE = "Local (Ollama: %s)"
CHAT_STATUS, CHAT_ERROR = "Ollama HTTP ", "Ollama Error: "
NOT_JSON = "The data couldn’t be read because it isn’t in the correct format."
CONTENT_DIAGNOSIS = "AI analysis generated for "
CONTENT_SOURCE = "Cloud (Gemini: %s)"


def string_at(body: Column, path: str) -> Column:
    """The JSON string at ``path``; null for broken JSON, a missing path or another type."""
    document = F.try_parse_json(body)
    is_string = F.schema_of_variant(F.try_variant_get(document, path, "variant")) == "STRING"
    return F.when(is_string, F.try_variant_get(document, path, "string"))


def succeeded(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def _failed() -> Column:
    return F.col("error").isNotNull() | ~succeeded(F.col("status"))


def _status_message(prefix: str, detail: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.col("status").cast("string"), F.lit("?")), F.lit(": "), detail)


def extract_chat(responses: DataFrame) -> DataFrame:
    """``responses`` plus ``answer``, ``error_kind`` and ``error_message`` of the chat endpoint.

    A failed status is reported with the whole body; a body that is no JSON object or array is a failed request.
    """
    answer = F.when(~_failed(), string_at(F.col("body"), CHAT_TEXT))
    kind = F.schema_of_variant(F.try_parse_json("body"))
    is_json = F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
    message = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit(CHAT_ERROR), F.col("error")))
        .when(_failed(), _status_message(CHAT_STATUS, F.coalesce("body", F.lit("<empty>"))))
        .when(~is_json, CHAT_ERROR + NOT_JSON)
    )
    return responses.withColumn("answer", answer).withColumns(
        {
            "error_kind": F.when(_failed() | ~is_json, REQUEST_FAILED).when(F.col("answer").isNull(), INVALID_RESPONSE),
            "error_message": message,
        }
    )


def extract_content(responses: DataFrame) -> DataFrame:
    """The same of the content endpoint, whose failures name the message in the body if there is one."""
    answer = F.when(~_failed(), string_at(F.col("body"), CONTENT_TEXT))
    detail = F.coalesce(tx.trim_blank(string_at(F.col("body"), "$.error.message")), F.col("body"), F.lit("<empty>"))
    message = F.when(F.col("error").isNotNull(), F.col("error")).when(_failed(), _status_message("HTTP ", detail))
    return responses.withColumn("answer", answer).withColumns(
        {
            "error_kind": F.when(_failed(), REQUEST_FAILED).when(F.col("answer").isNull(), INVALID_RESPONSE),
            "error_message": message,
        }
    )


def retryable(kind: Column, message: Column) -> Column:
    transient = F.lit(False)
    for mark in TRANSIENT_STATUS + TRANSIENT_NETWORK:
        transient = transient | message.contains(mark)
    return F.coalesce((kind == REQUEST_FAILED) & transient, F.lit(False))


def retry_triage(parsed_responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed attempts with the decision to retry and the pause before it, in seconds."""
    again = retryable(F.col("error_kind"), F.col("error_message"))
    retry = again & (F.col("attempt") < max_attempts)
    return parsed_responses.where(F.col("error_kind").isNotNull()).select(
        "request_id",
        "attempt",
        "error_kind",
        "error_message",
        again.alias("retryable"),
        retry.alias("retry"),
        F.when(retry, F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("backoff_seconds"),
    )


def final_attempts(parsed_responses: DataFrame) -> DataFrame:
    """The last attempt of each request."""
    columns = [name for name in parsed_responses.columns if name != "request_id"]
    last = F.max_by(F.struct(*columns), "attempt").alias("last")
    return parsed_responses.groupBy("request_id").agg(last).select("request_id", "last.*")


def chat_advice(requests: DataFrame, parsed_responses: DataFrame, model: str) -> DataFrame:
    return _advice(requests, parsed_responses, F.lit(CHAT_DIAGNOSIS), CHAT_SOURCE % model)


def content_advice(requests: DataFrame, parsed_responses: DataFrame, model: str) -> DataFrame:
    diagnosis = F.concat(F.lit(CONTENT_DIAGNOSIS), F.col("rule"), F.lit("."))
    return _advice(requests, parsed_responses, diagnosis, CONTENT_SOURCE % model)


def _advice(requests: DataFrame, parsed_responses: DataFrame, diagnosis: Column, source: str) -> DataFrame:
    """A request that nobody answered has timed out."""
    answers = parsed_responses.select("request_id", "answer", "error_kind", "error_message", F.lit(True).alias("answered"))
    joined = requests.join(answers, "request_id", "left").withColumn(
        "error_kind", F.when(F.col("answered").isNull(), TIMEOUT).otherwise(F.col("error_kind"))
    )
    return joined.select(
        "request_id",
        "rule",
        F.coalesce("type_name", F.lit("UnknownType")).alias("type_name"),
        "severity",
        diagnosis.alias("diagnosis"),
        F.lit(source).alias("model_source"),
        F.col("answer").alias("suggested_refactor"),
        "error_kind",
        "error_message",
    )


ADVICE_COLUMNS = ["request_id", "rule", "type_name", "severity", "diagnosis", "model_source", "suggested_refactor"]


def good_advice(advice: DataFrame) -> DataFrame:
    return advice.where(F.col("error_kind").isNull()).select(*ADVICE_COLUMNS)


def failed_advice(advice: DataFrame) -> DataFrame:
    """Requests whose advice failed: these rows are reported, the others go on."""
    return advice.where(F.col("error_kind").isNotNull()).select(
        "request_id", "rule", "type_name", "error_kind", "error_message"
    )


# Readable error texts.
ERROR_TEXT = {
    INVALID_CONFIGURATION: "Invalid AI configuration: %s",
    REQUEST_FAILED: "AI request failed: %s",
    TIMEOUT: "AI request timed out.",
    INVALID_RESPONSE: "AI provider returned an invalid response.",
    LOCAL_UNAVAILABLE: "Local AI unavailable: %s",
}


def error_text(kind: Column, message: Column) -> Column:
    chosen = None
    for code, template in ERROR_TEXT.items():
        text = F.replace(F.lit(template), F.lit("%s"), F.coalesce(message, F.lit("")))
        chosen = (F if chosen is None else chosen).when(kind == code, text)
    return chosen
