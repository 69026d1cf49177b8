"""Registered queries: each runs one operator, or a chain of them, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeaudit import schema
from typeaudit.functions import severity as sev
from typeaudit.functions import text as tx
from typeaudit.operators import (
    attribution, cascade, engine, extract, heuristics, ledger, provider, requests, responses, sections, summary,
)
from typeaudit.operators import rules as R
from typeaudit.plans import analysis, derived
from typeaudit.session import materialize, new_shared_path, remove_shared_path
from typeaudit.sinks import documents, reports
from typeaudit.sources import config as cfg
from typeaudit.sources import files
from typeaudit.streaming import summary as stream

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _issue_columns(df: DataFrame) -> DataFrame:
    return df.select("project", "path", "type_ord", "type_name", "rule_ord", "rule", "severity", "message")


def _type_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.analyze_types(derived.all_types(spark, sf_dir))


# --- classification and rules -----------------------------------------------------------


@query
def category(spark, sf_dir):
    return derived.all_types(spark, sf_dir).groupBy("class_type").agg(
        F.count("*").alias("types"), F.sum("method_count").alias("methods")
    )


def _single_rule(rule: R.Rule) -> Query:
    def run(spark, sf_dir):
        found = engine.evaluate(derived.all_types(spark, sf_dir), [rule])
        return engine.issues(found).select("path", "type_ord", "rule", "severity", "message")

    return run


REGISTRY["rule_large"] = _single_rule(R.LargeClass)
REGISTRY["rule_density"] = _single_rule(R.HighMethodDensity)
REGISTRY["rule_god"] = _single_rule(R.GodObject)
REGISTRY["rule_data_heavy"] = _single_rule(R.DataHeavyClass)


@query
def rule_custom(spark, sf_dir):
    """A user's rule beside the built-in ones: more than one property for each two methods."""
    lonely = R.Rule(
        "Lopsided",
        lambda settings: R.finding(
            "Lopsided",
            F.col("property_count") * 2 > F.col("method_count"),
            sev.WARNING,
            F.concat(F.col("name"), F.lit(" leans on its properties")),
        ),
    )
    found = engine.evaluate(derived.all_types(spark, sf_dir), [*R.DEFAULT_RULES, lonely])
    return engine.issues(found).groupBy("rule", "severity").agg(F.count("*").alias("issues"))


@query
def engine_raw(spark, sf_dir):
    found = engine.evaluate(derived.all_types(spark, sf_dir), suppress=False)
    return _issue_columns(engine.issues(found))


@query
def engine_suppressed(spark, sf_dir):
    return _issue_columns(_type_issues(spark, sf_dir))


@query
def engine_antijoin(spark, sf_dir):
    found = engine.evaluate(derived.all_types(spark, sf_dir), suppress=False)
    return _issue_columns(engine.suppress_redundant(engine.issues(found)))


# --- configuration ----------------------------------------------------------------------


@query
def config_merge(spark, sf_dir):
    merged = cfg.merge(derived.project_configs(spark, sf_dir))
    fields = [
        F.coalesce(F.col(f"rules.{key}.{field}").cast("string"), F.lit("-")).alias(f"{key}_{field}")
        for key in R.DEFAULT_THRESHOLDS
        for field in ("enabled", "threshold")
    ]
    return merged.select(
        "project", F.array_join(F.array_sort("ignore_directories"), ",").alias("folders"), *fields
    )


@query
def config_rules(spark, sf_dir):
    types = derived.customer_types(spark, sf_dir)
    configs = cfg.merge(derived.project_configs(spark, sf_dir))
    run = analysis.analyze_extracted(derived.type_files(spark, sf_dir), types, configs)
    return _issue_columns(run.issues)


# --- roll-ups ---------------------------------------------------------------------------


def _found_and_files(spark, sf_dir):
    return engine.evaluate(derived.all_types(spark, sf_dir)), derived.type_files(spark, sf_dir)


@query
def summary_total(spark, sf_dir):
    return summary.summary(*_found_and_files(spark, sf_dir))


@query
def summary_by_project(spark, sf_dir):
    return summary.summary_by_project(*_found_and_files(spark, sf_dir))


@query
def summary_rollup(spark, sf_dir):
    rolled = summary.summary_rollup(*_found_and_files(spark, sf_dir))
    return rolled.withColumns({"project": F.coalesce("project", F.lit("*")), "path": F.coalesce("path", F.lit("*"))})


@query
def issues_per_file(spark, sf_dir):
    return summary.issues_per_file(_type_issues(spark, sf_dir), derived.type_files(spark, sf_dir))


@query
def leaderboard(spark, sf_dir):
    return summary.leaderboard(_type_issues(spark, sf_dir))


@query
def file_head(spark, sf_dir):
    return summary.file_head(_type_issues(spark, sf_dir)).select(
        "project", "path", "position", "type_name", "rule", "message", "issue_count", "more"
    )


@query
def severity_views(spark, sf_dir):
    level = F.col("severity")
    return (
        _type_issues(spark, sf_dir)
        .groupBy(
            sev.rank(level).alias("rank"), sev.label(level).alias("label"), sev.emoji(level).alias("emoji"),
            sev.diagnostic_level(level).alias("level"), sev.actionable(level).alias("actionable"),
        )
        .agg(F.count("*").alias("issues"))
    )


@query
def best_per_type(spark, sf_dir):
    return _issue_columns(summary.best_per_type(_type_issues(spark, sf_dir)))


# --- attribution and reports ------------------------------------------------------------


def _attributed(spark, sf_dir, mode: str) -> DataFrame:
    types = derived.all_types(spark, sf_dir)
    if mode == "substring":
        # Message matching reads the types four times.
        types = materialize(types, "types")
    return attribution.attribute(engine.analyze_types(types), types, mode)


@query
def attribution_lineage(spark, sf_dir):
    return _attributed(spark, sf_dir, "lineage").select("path", "type_ord", "rule", "matched_name")


@query
def attribution_substring(spark, sf_dir):
    return _attributed(spark, sf_dir, "substring").select("path", "type_ord", "rule", "matched_ord", "matched_name")


@query
def report_records(spark, sf_dir):
    return attribution.reports(_attributed(spark, sf_dir, "lineage")).drop("line")


@query
def report_json(spark, sf_dir):
    return reports.report_json(attribution.reports(_attributed(spark, sf_dir, "lineage")))


@query
def report_array(spark, sf_dir):
    """One JSON document over many files, committed and read back."""
    order = [*schema.TYPE_KEY, "rule_ord"]
    path = new_shared_path(spark, "report-array")
    documents.write_array(attribution.reports(_attributed(spark, sf_dir, "lineage"), order), path, order)
    record = "file string, line int, message string, rule string, severity string, typeName string"
    return documents.read_array(spark, path, record).drop("line")


@query
def report_diagnostic(spark, sf_dir):
    root = F.concat(F.lit("/src/"), F.col("project"))
    return reports.diagnostic_lines(_type_issues(spark, sf_dir), root).select("line")


@query
def report_diagnostic_summary(spark, sf_dir):
    return reports.diagnostic_summary(summary.summary(*_found_and_files(spark, sf_dir)))


def _tables(spark, sf_dir) -> reports.Tables:
    found, sources = _found_and_files(spark, sf_dir)
    return reports.Tables(sources, found, engine.issues(found))


@query
def report_files(spark, sf_dir):
    return reports.file_report_lines(_tables(spark, sf_dir))


@query
def report_member_map(spark, sf_dir):
    """The text report of types that have members: a method each, one line longer than the one before."""
    found, sources = _found_and_files(spark, sf_dir)
    member = "struct('m' || i AS name, i AS start_line, 2 * i AS end_line)"
    members = F.expr(f"transform(sequence(0, method_count), i -> {member})")
    found = found.withColumn("members", F.slice(members, 2, F.col("method_count")))
    return reports.file_report_lines(reports.Tables(sources, found, engine.issues(found)))


@query
def report_custom(spark, sf_dir):
    """A reporter of the user's own: a line for each rule and severity of a project."""

    def by_rule(tables: reports.Tables) -> DataFrame:
        counted = tables.issues.groupBy("project", "rule", "severity").agg(F.count("*").alias("n"))
        return counted.select(F.format_string("%s: %s (%s) x %d", "project", "rule", "severity", "n").alias("line"))

    reporter: reports.Reporter = by_rule
    return reporter(_tables(spark, sf_dir))


@query
def report_summary(spark, sf_dir):
    lines = reports.summary_report_lines(_tables(spark, sf_dir))
    return lines.select("section", F.coalesce("path", F.lit("-")).alias("path"), "line_ord", "line")


# --- sources ----------------------------------------------------------------------------


def _page_files(spark, sf_dir) -> DataFrame:
    pages = derived.table(spark, sf_dir, "pages")
    address = F.regexp_replace("url", r"^[a-z]+://", "")
    return pages.select(
        F.concat(F.lit("p"), (F.col("page_id") % 3).cast("string")).alias("project"),
        F.concat(
            F.element_at(F.array(F.lit("Pods/"), F.lit("Sources/"), F.lit("my.build/"), F.lit("Build/")), (F.col("page_id") % 4 + 1).cast("int")),
            address,
        ).alias("path"),
        "page_id",
    )


@query
def scan_prune(spark, sf_dir):
    kept = files.prune(_page_files(spark, sf_dir), files.default_ignored(["de", "Pods"]))
    return kept.select("page_id", "project", "path", tx.base_name(F.col("path")).alias("file_name"))


@query
def scan_prune_table(spark, sf_dir):
    """Ignored folders per project as a table: each nation's language-like code in one project."""
    ignored = derived.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), (F.col("n_nationkey") % 3).cast("string")).alias("project"),
        F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("Build")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("component"),
    )
    return files.prune_by_table(_page_files(spark, sf_dir), ignored).select("page_id", "project", "path")


@query
def input_check(spark, sf_dir):
    number = F.col("page_id") % 5
    inputs = derived.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(number == 0, F.concat("url", F.lit("/A.swift")))
        .when(number == 1, F.concat("url", F.lit("/B.SWIFT")))
        .when(number == 2, F.concat("url", F.lit("/.swift")))
        .otherwise(F.col("url"))
        .alias("path"),
        (F.col("page_id") % 7 == 0).alias("is_directory"),
    )
    return files.check_inputs(inputs).withColumn("input_error", F.coalesce("input_error", F.lit("ok")))


def _bytes(spark, sf_dir) -> DataFrame:
    """Documents as bytes; every seventh one is cut open by a stray byte."""
    content = F.encode("text", "UTF-8")
    broken = F.concat(content, F.unhex(F.lit("FF")), content)
    return derived.table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 7 == 0, broken).otherwise(content).alias("content"),
    )


@query
def utf8_decode(spark, sf_dir):
    sources = files.from_table(_bytes(spark, sf_dir), "project", "path", "content")
    return sources.select(
        "project", "path", "file_name", F.coalesce("read_error", F.lit("-")).alias("read_error"),
        F.coalesce(F.length("text"), F.lit(-1)).cast("bigint").alias("characters"),
    )


@query
def read_error_flag(spark, sf_dir):
    return files.any_error(files.from_table(_bytes(spark, sf_dir), "project", "path", "content"))


@query
def line_count(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select(
        "doc_id", tx.line_count(F.col("text")).cast("bigint").alias("lines")
    )


@query
def snippet(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select("doc_id", tx.head_lines(F.col("text"), 3).alias("snippet"))


# --- extraction -------------------------------------------------------------------------


@query
def tokens(spark, sf_dir):
    rows = extract.tokens(derived.document_sources(spark, sf_dir))
    counts = [
        F.count_if(F.col("keyword") == word).alias(f"n_{word}")
        for word in ("class", "struct", "func", "var", "let", "init", "subscript")
    ]
    return rows.groupBy("project", "path").agg(
        *counts,
        F.count_if(F.col("kind") == "{").alias("n_open"),
        F.count_if(F.col("kind") == "}").alias("n_close"),
        F.max("line_to").alias("line_breaks"),
    )


def _member_text() -> Column:
    return F.array_join(
        F.transform("members", lambda m: F.format_string("%s:%d-%d", m["name"], m["start_line"], m["end_line"])), ";"
    )


@query
def types(spark, sf_dir):
    return extract.extract_types(derived.document_sources(spark, sf_dir)).withColumn("members", _member_text())


def _built_types(spark, sf_dir, text) -> DataFrame:
    """Types of one source text per document."""
    built = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), text.alias("text"))
    found = extract.extract_types(files.from_table(built, "id", "id", "text"))
    return found.select("path", "type_ord", "name", "method_count", "property_count", "line_count")


@query
def types_nested(spark, sf_dir):
    """Each document's text in a nested comment and in a raw literal, beside generic clauses and groups, to a depth that varies."""
    depth = (F.col("doc_id") % 40 + 1).cast("int")
    times = lambda part, n: F.repeat(F.lit(part), n)
    # Neither closes before its end.
    held = F.translate("text", '*"', "")
    text = F.concat(
        F.lit("class T"), F.col("doc_id"), F.lit(" {\n  var a: "), times("A<", depth), F.lit("Int, Int"), times(">", depth),
        F.lit("\n  "), times("/*", depth), F.lit(" {\n"), held, F.lit("\n"), times("*/", depth), F.lit("\n  let b = "),
        times("#", depth), F.lit('"""\n} '), held, F.lit('\n"""'), times("#", depth), F.lit("\n  func f() { "), times("(", depth),
        F.lit("1, 2"), times(")", depth), F.lit(" }\n}"),
    )
    return _built_types(spark, sf_dir, text)


@query
def types_unclosed(spark, sf_dir):
    """A type that never closes, with a method for each line of the document's text, which is a remark."""
    remark = lambda line: F.concat(F.lit('  func f() { "}" } // { '), F.translate(line, tx.NEWLINES, ""))
    methods = F.array_join(F.transform(F.split("text", "\n", -1), remark), "\n")
    return _built_types(spark, sf_dir, F.concat(F.lit("struct U"), F.col("doc_id"), F.lit(" {\n  var a = 1\n"), methods))


@query
def members(spark, sf_dir):
    return extract.members(extract.extract_types(derived.document_sources(spark, sf_dir)))


@query
def extracted_issues(spark, sf_dir):
    found = engine.evaluate(extract.extract_types(derived.document_sources(spark, sf_dir)))
    return _issue_columns(engine.issues(found))


@query
def extracted_leaderboard(spark, sf_dir):
    found = engine.evaluate(extract.extract_types(derived.document_sources(spark, sf_dir)))
    return summary.leaderboard(engine.issues(found), 20)


@query
def extracted_summary(spark, sf_dir):
    sources = derived.document_sources(spark, sf_dir)
    return summary.summary(engine.evaluate(extract.extract_types(sources)), sources)


@query
def stream_summary(spark, sf_dir):
    """The same summary, with the documents read as a stream."""
    arriving = derived.table_stream(spark, sf_dir, "documents")
    out, checkpoint = new_shared_path(spark, "stream-summary"), new_shared_path(spark, "stream-checkpoint")
    tasks = derived.task_count(spark, derived.table(spark, sf_dir, "documents"))
    running = stream.start_summary(derived.as_document_sources(arriving), out, checkpoint, partitions=tasks)
    running.awaitTermination()
    total = stream.summary_so_far(spark, out)
    row = total.collect()
    for folder in (out, checkpoint):
        remove_shared_path(spark, folder)
    return spark.createDataFrame(row, total.schema)


# --- advice -----------------------------------------------------------------------------


def _requests(spark, sf_dir, maximum: int | None = requests.MAX_SUGGESTIONS) -> DataFrame:
    return requests.select_requests(engine.evaluate(derived.all_types(spark, sf_dir)), maximum)


def _all_requests(spark, sf_dir) -> DataFrame:
    """One request per type with an actionable finding."""
    return _requests(spark, sf_dir, None)


@query
def request_selection(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", "path", "type_name", "rule", "severity", "request_rank")


@query
def request_selection_by_name(spark, sf_dir):
    # Message matching reads the types five times.
    types = materialize(derived.all_types(spark, sf_dir), "types")
    attributed = attribution.attribute(engine.analyze_types(types), types, "substring", attribution.UNKNOWN_CLASS)
    chosen = requests.select_requests_from_issues(attributed, types, by_name=True)
    return chosen.select("path", "type_name", "type_ord", "rule", "severity", "request_rank", "method_count")


def _prompts(spark, sf_dir, compact: bool) -> DataFrame:
    sources = derived.document_sources(spark, sf_dir)
    # Thresholds low enough for small documents to be worth a request.
    settings = R.Settings(largeClass=(True, 0), highMethodDensity=(True, 1))
    run = analysis.analyze(sources, settings=settings, keep_types=False)
    return run.requests(snippet_lines=12, compact=compact).select("path", "type_ord", "rule", "prompt")


@query
def prompt_standard(spark, sf_dir):
    return _prompts(spark, sf_dir, compact=False)


@query
def prompt_compact(spark, sf_dir):
    return _prompts(spark, sf_dir, compact=True)


def _advice_columns(df: DataFrame) -> DataFrame:
    return df.select(*responses.ADVICE_COLUMNS)


@query
def heuristics_local(spark, sf_dir):
    """Fixed advice for every finding, suppressed or not."""
    found = engine.evaluate(derived.all_types(spark, sf_dir), suppress=False)
    asked = engine.issues(found).withColumn("request_id", F.concat_ws("|", *schema.TYPE_KEY, "rule"))
    return _advice_columns(heuristics.local_advice(asked))


@query
def heuristics_augmented(spark, sf_dir):
    text = F.concat(F.lit("Model says: "), F.col("message"))
    return _advice_columns(heuristics.augmented_advice(_all_requests(spark, sf_dir), text, "audit.mlmodelc"))


@query
def static_advice(spark, sf_dir):
    return _advice_columns(heuristics.static_advice(_all_requests(spark, sf_dir)))


@query
def provider_plugin(spark, sf_dir):
    """A provider of the user's own, asked in Arrow batches."""

    def count_words(batch):
        return batch.assign(
            diagnosis=batch["rule"] + " in " + batch["type_name"],
            model_source="word counter",
            suggested_refactor=batch["prompt"].str.split(" ").str.len().astype(str) + " words",
            error_kind=None,
        )[["request_id", "diagnosis", "model_source", "suggested_refactor", "error_kind"]]

    asked = _all_requests(spark, sf_dir).withColumn("prompt", F.col("message"))
    return provider.ask(asked, count_words).drop("error_kind")


@query
def provider_ledger(spark, sf_dir):
    """Many requests, few distinct prompts: each is asked once, and a second run asks nothing."""

    def first(batch):
        return batch.assign(
            diagnosis=batch["prompt"].str.upper(), model_source="ledger",
            suggested_refactor=batch["prompt"].str.len().astype(str), error_kind=None,
        )

    def never(batch):
        raise RuntimeError("asked again")

    prompt = F.concat_ws(" ", "project", "rule", "severity")
    asked = _all_requests(spark, sf_dir).withColumn("prompt", prompt)
    folder = new_shared_path(spark, "ledger")
    ledger.ask_once(asked, first, folder)
    return ledger.ask_once(asked, never, folder).drop("error_kind")


def _escaped(text: Column) -> Column:
    """``text`` as a JSON string literal."""
    object_text = F.to_json(F.struct(text.alias("t")))
    return F.substring(object_text, F.lit(6), F.length(object_text) - 6)


def _log(spark, sf_dir) -> DataFrame:
    """Conversation turns as answers of an endpoint: good ones, broken ones and failures."""
    turns = derived.table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 8
    chat = F.concat(F.lit('{"choices":[{"message":{"content":'), _escaped(F.col("text")), F.lit("}}]}"))
    content = F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), _escaped(F.col("text")), F.lit("}]}}]}"))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        (F.col("turn") % 3 + 1).cast("int").alias("attempt"),
        F.when(kind == 6, F.lit(None)).when(kind == 4, 429).when(kind == 5, 500).otherwise(200).cast("int").alias("status"),
        F.when(kind <= 1, chat)
        .when(kind == 2, content)
        .when(kind == 3, F.lit('{"choices":[{"message":{"content":5}}]}'))
        .when(kind == 4, F.concat(F.lit('{"error":{"message":'), _escaped(F.concat(F.lit(" busy "), F.col("role"), F.lit("  "))), F.lit("}}")))
        .when(kind == 5, F.concat(F.lit("oops "), F.col("role")))
        .when(kind == 7, F.lit("{broken"))
        .alias("body"),
        F.when(
            kind == 6,
            F.when(F.col("turn") % 2 == 0, "URL_ERROR -1001: timed out").otherwise("URL_ERROR -1002: bad address"),
        ).alias("error"),
    )


def _parsed_view(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id", "attempt",
        *[F.coalesce(name, F.lit("-")).alias(name) for name in ("answer", "error_kind", "error_message")],
    )


@query
def chat_extract(spark, sf_dir):
    return _parsed_view(responses.extract_chat(_log(spark, sf_dir)))


@query
def content_extract(spark, sf_dir):
    return _parsed_view(responses.extract_content(_log(spark, sf_dir)))


@query
def retry_triage(spark, sf_dir):
    triage = responses.retry_triage(responses.extract_content(_log(spark, sf_dir)))
    pause = F.coalesce(F.col("backoff_seconds").cast("int"), F.lit(0))
    return triage.withColumn("backoff_seconds", pause).drop("error_message")


@query
def final_attempts(spark, sf_dir):
    """Turns of a conversation as attempts at one request."""
    attempts = responses.extract_chat(
        _log(spark, sf_dir).select(
            F.substring_index("request_id", "-", 1).alias("request_id"),
            F.substring_index("request_id", "-", -1).cast("int").alias("attempt"),
            "status", "body", "error",
        )
    )
    return _parsed_view(responses.final_attempts(attempts))


def _turn_requests(spark, sf_dir) -> DataFrame:
    """A request per conversation turn: rule by turn, no type for every ninth one."""
    turns = derived.table(spark, sf_dir, "conversations")
    number = F.col("conv_id") + F.col("turn")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.element_at(F.array(*[F.lit(rule.name) for rule in R.DEFAULT_RULES]), (F.col("turn") % 4 + 1).cast("int")).alias("rule"),
        F.when(number % 9 != 0, F.concat(F.lit("Conv"), F.col("conv_id").cast("string"), F.lit("Service"))).alias("type_name"),
        F.when(F.col("turn") % 2 == 0, sev.WARNING).otherwise(sev.CRITICAL).alias("severity"),
        F.col("text"),
    )


def _chat_advice(spark, sf_dir) -> DataFrame:
    return responses.chat_advice(_turn_requests(spark, sf_dir), responses.extract_chat(_log(spark, sf_dir)), "coder")


def _content_advice(spark, sf_dir) -> DataFrame:
    return responses.content_advice(
        _turn_requests(spark, sf_dir), responses.extract_content(_log(spark, sf_dir)), "flash"
    )


@query
def advice_good(spark, sf_dir):
    return responses.good_advice(_chat_advice(spark, sf_dir))


@query
def advice_failed(spark, sf_dir):
    """Of some requests no answer has arrived."""
    arrived = _log(spark, sf_dir).where(F.coalesce(~F.col("body").contains('"content":5'), F.lit(True)))
    answers = responses.extract_content(arrived)
    failed = responses.failed_advice(responses.content_advice(_turn_requests(spark, sf_dir), answers, "flash"))
    return failed.select(
        "request_id", "rule", "error_kind", responses.error_text(F.col("error_kind"), F.col("error_message")).alias("error_text")
    )


def _fallback_advice(spark, sf_dir) -> DataFrame:
    """A fallback tier that does not know about density."""
    known = _turn_requests(spark, sf_dir).where(F.col("rule") != R.METHOD_DENSITY)
    return heuristics.local_advice(known)


@query
def cascade_local_first(spark, sf_dir):
    return cascade.local_first(
        _turn_requests(spark, sf_dir), _chat_advice(spark, sf_dir), _fallback_advice(spark, sf_dir),
        _content_advice(spark, sf_dir),
    )


@query
def advice_confidence(spark, sf_dir):
    """Turns cut near the limit, with an accent on each vowel: clusters are fewer than code points."""
    cut = F.substring(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit(1), (F.col("conv_id") % 12 + 45).cast("int"))
    marked = F.regexp_replace(cut, "([aeiou])", "$1\u0301")
    return derived.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.grapheme_count(marked).cast("long").alias("characters"), cascade.confident(F.lit(""), marked).alias("is_confident")
    )


@query
def cascade_local_only(spark, sf_dir):
    return cascade.local_first(
        _turn_requests(spark, sf_dir), _chat_advice(spark, sf_dir), _fallback_advice(spark, sf_dir)
    )


@query
def cascade_cloud_first(spark, sf_dir):
    return cascade.cloud_first(
        _turn_requests(spark, sf_dir), _content_advice(spark, sf_dir), _fallback_advice(spark, sf_dir)
    )


def _free_text_advice(spark, sf_dir) -> DataFrame:
    """Documents as advice: header lines are set between the lines of the text by their index."""

    def dressed(line: Column, index: Column) -> Column:
        return (
            F.when(index % 11 == 4, F.concat(F.lit("**1) Root Cause**: "), line))
            .when(index % 11 == 6, F.lit("## Refactor STEPS"))
            .when(index % 11 == 8, F.lit("quick win and root cause"))
            .when(index % 11 == 9, F.concat(F.lit("Quick Win "), line))
            .when(index % 3 == 0, F.concat(F.lit("  - `"), line, F.lit("` • x ")))
            .when(index % 3 == 1, F.concat(F.lit("* **"), line, F.lit("** ")))
            .otherwise(F.lit("  "))
        )

    text = F.array_join(F.transform(F.split("text", "\n", -1), dressed), "\n")
    return derived.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.lit(R.LARGE_CLASS).alias("rule"),
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string")).alias("type_name"),
        F.when(F.col("doc_id") % 2 == 0, sev.WARNING).otherwise(sev.CRITICAL).alias("severity"),
        F.concat(F.lit(" **about** `"), F.col("lang"), F.lit("` ")).alias("diagnosis"),
        F.col("source").alias("model_source"),
        text.alias("suggested_refactor"),
    )


@query
def advice_sections(spark, sf_dir):
    return sections.advice_lines(_free_text_advice(spark, sf_dir))


@query
def advice_report(spark, sf_dir):
    return sections.advice_report(_free_text_advice(spark, sf_dir))


@query
def advice_report_verbose(spark, sf_dir):
    return sections.advice_report(_free_text_advice(spark, sf_dir), verbose=True)


@query
def advice_report_heuristic(spark, sf_dir):
    """Report of the fixed advice: of each structured text only the refactor bullets survive."""
    return sections.advice_report(heuristics.local_advice(_all_requests(spark, sf_dir)))


@query
def advice_report_files(spark, sf_dir):
    """The fixed advice of each file, under the file's name and between rules."""
    asked = _all_requests(spark, sf_dir)
    return sections.file_advice(heuristics.local_advice(asked), asked)


@query
def advice_after_failure(spark, sf_dir):
    """The fixed advice where a model was asked and failed."""
    return _advice_columns(heuristics.local_advice(_all_requests(spark, sf_dir), after_failure=True))


@query
def compact_lines(spark, sf_dir):
    advice = _free_text_advice(spark, sf_dir)
    return advice.select(
        "request_id", F.array_join(sections.compact_lines(F.col("suggested_refactor"), 8), "|").alias("compact")
    )
