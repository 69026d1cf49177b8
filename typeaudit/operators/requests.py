"""Advice requests: the worst finding of each type, capped per file, with its prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.functions import severity as sev
from typeaudit.functions import text as tx
from typeaudit.operators import engine, summary

# Defaults of the request stage.
MAX_SUGGESTIONS = 5
SNIPPET_LINES = 120

_TYPE_COLUMNS = [
    "method_count", "property_count", "line_count", "initializer_count", "subscript_count", "accessor_count", "members",
]


def _cap(best: DataFrame, maximum: int | None) -> DataFrame:
    """The ``maximum`` most severe requests of each file, earlier ones first among equals.

    The rank filter runs before the exchange too, so a file sends at most ``maximum`` rows per
    map task. ``None`` keeps every request, without any exchange.
    """
    if maximum is None:
        return best
    if maximum < 0:
        raise ValueError("the number of suggestions must not be negative")
    worst_first = W.partitionBy(*schema.FILE_KEY).orderBy(
        F.desc(sev.rank(F.col("severity"))), "type_ord", "rule_ord"
    )
    return best.withColumn("request_rank", F.row_number().over(worst_first)).where(F.col("request_rank") <= maximum)


def _with_id(requests: DataFrame) -> DataFrame:
    return requests.withColumn("request_id", F.concat_ws("|", *schema.TYPE_KEY, "rule"))


def select_requests(found: DataFrame, maximum: int | None = MAX_SUGGESTIONS) -> DataFrame:
    """Requests straight from ``engine.evaluate``: all findings of a type share its row, so the
    worst one is picked in the row and the only exchange is the per-file cap."""
    names = engine.finding_columns(found)
    slots = [
        F.struct(F.lit(i).alias("rule_ord"), F.col(name).alias("finding")) for i, name in enumerate(names)
    ]
    worst = F.coalesce(
        *[
            F.when(F.col(f"{name}.severity") == level, slot)
            for level in (sev.CRITICAL, sev.WARNING)
            for name, slot in zip(names, slots, strict=True)
        ]
    )
    # The one-element explode keeps the null test above the projection: pushed below, it would
    # evaluate all rules a second time.
    best = (
        found.select(
            *schema.TYPE_KEY, "file_name", F.col("name").alias("type_name"), *_TYPE_COLUMNS,
            F.explode(F.array(worst)).alias("worst"),
        )
        .where(F.col("worst").isNotNull())
        .select(
            *schema.TYPE_KEY, "file_name", "type_name", *_TYPE_COLUMNS, "worst.rule_ord",
            "worst.finding.rule", "worst.finding.severity", "worst.finding.message",
        )
    )
    return _with_id(_cap(best, maximum))


def select_requests_from_issues(
    attributed: DataFrame, types: DataFrame, maximum: int | None = MAX_SUGGESTIONS, by_name: bool = False
) -> DataFrame:
    """Requests from an attributed issue table; ``by_name`` groups like message matching does."""
    best = summary.best_per_type(attributed, "matched_name" if by_name else "type_ord")
    capped = _cap(best, maximum)
    details = types.select(
        *schema.FILE_KEY, F.col("type_ord").alias("matched_ord"), F.col("name").alias("matched_type"), *_TYPE_COLUMNS
    )
    return _with_id(
        capped.join(details, [*schema.FILE_KEY, "matched_ord"], "left").withColumn("type_name", F.col("matched_type"))
    ).drop("matched_type")


def snippets(sources: DataFrame, line_limit: int = SNIPPET_LINES) -> DataFrame:
    """First lines of each readable file."""
    return sources.where(F.col("text").isNotNull()).select(
        *schema.FILE_KEY, tx.head_lines(F.col("text"), line_limit).alias("snippet")
    )


def with_snippet(requests: DataFrame, sources: DataFrame, line_limit: int = SNIPPET_LINES) -> DataFrame:
    return requests.join(snippets(sources, line_limit), schema.FILE_KEY, "left").withColumn(
        "snippet", F.coalesce("snippet", F.lit(""))
    )


def with_kept_snippet(requests: DataFrame, kept: DataFrame, line_limit: int) -> DataFrame:
    """The same from rows of files that hold at least as many lines."""
    heads = kept.select(*schema.FILE_KEY, tx.head_lines(F.col("snippet"), line_limit).alias("snippet"))
    return requests.join(heads, schema.FILE_KEY, "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


# Prompt wording that answers are tuned to.
STANDARD_PROMPT = """\
You are a senior Swift architect.
Analyze this finding and provide concise, actionable refactor guidance.

Rule: %s
Severity: %s
Issue message: %s
Type: %s

%s

Code Snippet:
%s

Return:
1) Root cause (1-2 lines)
2) Refactor steps (3-5 bullets)
3) Quick win (1 bullet)"""

COMPACT_PROMPT = """\
You are a Swift refactoring assistant.
Rule: %s
Severity: %s
Message: %s
Type: %s

%s

Code Snippet:
%s"""

PROFILE = """\
Structural Profile:
- Initializers: %d
- Computed Properties (Accessors): %d
- Subscripts: %d
- Methods: %d
- Total Lines: %d

Member Map (Relative line ranges):
%s"""


def profile() -> Column:
    """Counts and member map of the type; '' for a request without one."""
    from typeaudit.sinks.reports import member_lines

    members = F.coalesce(F.array_join(member_lines(F.col("members"), "  "), "\n"), F.lit(""))
    return F.when(
        F.col("method_count").isNotNull(),
        F.format_string(
            PROFILE, "initializer_count", "accessor_count", "subscript_count", "method_count", "line_count", members
        ),
    ).otherwise("")


def prompt(compact: bool = False) -> Column:
    return F.format_string(
        COMPACT_PROMPT if compact else STANDARD_PROMPT,
        F.col("rule"),
        sev.emoji(F.col("severity")),
        F.col("message"),
        F.coalesce("type_name", F.lit("UnknownType")),
        profile(),
        F.col("snippet"),
    )


def with_prompt(requests: DataFrame, compact: bool = False) -> DataFrame:
    return requests.withColumn("prompt", prompt(compact))
