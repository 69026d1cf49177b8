"""SQL statements that compute the registered queries independently, in plain SQL."""

from __future__ import annotations

SUFFIX = "(['ViewController','ViewModel','Service','Model','Widget'])"


def _category(name: str) -> str:
    return f"""CASE WHEN lower({name}) LIKE '%viewcontroller%' THEN 'viewController'
        WHEN lower({name}) LIKE '%viewmodel%' THEN 'viewModel'
        WHEN lower({name}) LIKE '%service%' OR lower({name}) LIKE '%manager%' THEN 'service'
        WHEN lower({name}) LIKE '%model%' THEN 'model' ELSE 'unknown' END"""


_DERIVED = f"""
customer_raw AS (
  SELECT n_name AS project, 'customers/' || n_name AS path, c_custkey AS type_ord,
         c_custkey || {SUFFIX}[c_custkey % 5 + 1] AS name,
         coalesce(m, 0) AS method_count, coalesce(p, 0) AS property_count, coalesce(l, 0) AS line_count
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS m, count(*) FILTER (o_orderstatus = 'O') AS p, sum(coalesce(items, 0)) AS l
             FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1)
               ON o_orderkey = l_orderkey GROUP BY 1) ON o_custkey = c_custkey),
part_raw AS (
  SELECT 'parts' AS project, 'parts/' || p_brand AS path, p_partkey AS type_ord,
         p_partkey || {SUFFIX}[p_size % 5 + 1] AS name, m AS method_count, p AS property_count, l AS line_count
  FROM part JOIN (SELECT l_partkey, count(*) AS m, count(DISTINCT l_suppkey) AS p, sum(l_linenumber) AS l
                  FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
raw_types AS (SELECT * FROM part_raw UNION ALL SELECT * FROM customer_raw),
types AS (
  SELECT project, path, split_part(path, '/', 2) AS file_name, type_ord, {_category('name')} AS class_type, name,
         method_count::BIGINT AS method_count, property_count::BIGINT AS property_count,
         line_count::BIGINT AS line_count, type_ord % 3 AS initializer_count, type_ord % 2 AS subscript_count,
         type_ord % 4 AS accessor_count
  FROM raw_types),
type_files AS (
  SELECT DISTINCT 'parts' AS project, 'parts/' || p_brand AS path, p_brand AS file_name FROM part
  UNION ALL SELECT n_name, 'customers/' || n_name, n_name FROM nation
  UNION ALL SELECT r_name, 'regions/' || r_name, r_name FROM region)"""

# One file per document; the class of the document and a nested struct for every sixth line.
_DOCUMENT_TYPES = f"""
doc_lines AS (
  SELECT doc_id, source AS project, lang || '/' || doc_id || '.swift' AS path, doc_id || '.swift' AS file_name,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
doc_parts AS (
  SELECT *, CASE i % 6 WHEN 0 THEN 'p' || i WHEN 1 THEN 'm' || i WHEN 2 THEN 'init' WHEN 3 THEN 'c' || i
                       WHEN 4 THEN 'subscript' ELSE 'struct' END AS member,
         CASE i % 6 WHEN 1 THEN 4 WHEN 3 THEN 3 WHEN 5 THEN 3 ELSE 1 END AS lines
  FROM doc_lines),
doc_members AS (
  SELECT *, coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start_line,
         sum(lines) OVER (PARTITION BY doc_id ORDER BY i) AS end_line
  FROM doc_parts),
types AS (
  SELECT project, path, file_name, 0 AS type_ord, {_category("'doc' || (" + SUFFIX + "[doc_id % 5 + 1])")} AS class_type,
         'Doc' || doc_id || {SUFFIX}[doc_id % 5 + 1] AS name,
         count(*) FILTER (i % 6 = 1) AS method_count,
         2 * count(*) FILTER (i % 6 = 0) + count(*) FILTER (i % 6 = 3) AS property_count,
         (sum(lines) + 3)::BIGINT AS line_count,
         count(*) FILTER (i % 6 = 2) AS initializer_count, count(*) FILTER (i % 6 = 4) AS subscript_count,
         count(*) FILTER (i % 6 = 3) AS accessor_count,
         string_agg(member || ':' || start_line || '-' || end_line, ';' ORDER BY i) AS members
  FROM doc_members GROUP BY project, path, file_name, doc_id
  UNION ALL
  SELECT project, path, file_name, (i + 1) // 6, 'unknown', 'N' || i, 0, 1, 3, 0, 0, 0, 'z:1-1'
  FROM doc_lines WHERE i % 6 = 5)"""


def _limit(*values: int | str) -> str:
    names = ("viewController", "viewModel", "service", "model", "unknown")
    whens = " ".join(f"WHEN '{name}' THEN {value}" for name, value in zip(names, values, strict=True))
    return f"(CASE class_type {whens} END)"


def _raw_issues(large: str = "10", density: str = "10", heavy: str = "5", on: tuple[str, ...] = ("true",) * 4) -> str:
    """CTEs `limits` and `raw_issues` over `types`."""
    return f"""
limits AS (
  SELECT *, {_limit(25, 20, 15, 10, large)} AS lm, {_limit(400, 300, 250, 150, 300)} AS ll,
         {_limit(18, 12, 10, 6, density)} AS dm, {_limit(40, 30, 25, 15, 30)} AS gm,
         {_limit(20, 15, 12, 20, 15)} AS gp, {_limit(600, 450, 350, 250, 400)} AS gl
  FROM types),
raw_issues AS (
  SELECT project, path, file_name, type_ord, name AS type_name, 0 AS rule_ord, 'LargeClass' AS rule,
         CASE WHEN method_count > 2 * lm OR line_count > 2 * ll THEN 'critical' ELSE 'warning' END AS severity,
         'Type ' || name || ' is too large: ' || concat_ws(', ',
           CASE WHEN method_count > lm THEN method_count || ' methods (limit: ' || lm || ')' END,
           CASE WHEN line_count > ll THEN line_count || ' lines (limit: ' || ll || ')' END) AS message
  FROM limits WHERE ({on[0]}) AND (method_count > lm OR line_count > ll)
  UNION ALL
  SELECT project, path, file_name, type_ord, name, 1, 'HighMethodDensity',
         CASE WHEN method_count > 2 * dm THEN 'critical' ELSE 'warning' END,
         'Class ' || name || ' has high method density (' || method_count || ' methods). Consider splitting into multiple responsibilities.'
  FROM limits WHERE ({on[1]}) AND line_count BETWEEN 20 AND 350 AND method_count > dm AND method_count > 0
    AND line_count <= 15 * method_count
  UNION ALL
  SELECT project, path, file_name, type_ord, name, 2, 'GodObject', 'critical',
         'Type ' || name || ' is a God Object (Major SRP violation). It exceeds multiple limits: ' || concat_ws(', ',
           CASE WHEN method_count > gm THEN method_count || ' methods' END,
           CASE WHEN property_count > gp THEN property_count || ' properties' END,
           CASE WHEN line_count > gl THEN line_count || ' lines' END) || '.'
  FROM limits WHERE ({on[2]})
    AND (method_count > gm)::INT + (property_count > gp)::INT + (line_count > gl)::INT >= 2
  UNION ALL
  SELECT project, path, file_name, type_ord, name, 3, 'DataHeavyClass', 'info',
         'Type ' || name || ' has too many properties (' || property_count || ').'
  FROM limits WHERE ({on[3]}) AND property_count > {heavy})"""


_SUPPRESSED = """
issues AS (
  SELECT r.* FROM raw_issues r
  WHERE NOT (rule IN ('LargeClass', 'DataHeavyClass') AND EXISTS (
    SELECT 1 FROM raw_issues g WHERE g.rule = 'GodObject' AND g.project = r.project AND g.path = r.path
      AND g.type_ord = r.type_ord)))"""

_EMOJI = "(CASE severity WHEN 'info' THEN 'ℹ️' WHEN 'warning' THEN '⚠️' ELSE '🔴' END)"
_RANK = "(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END)"
_LEVEL = "(CASE severity WHEN 'info' THEN 'note' WHEN 'warning' THEN 'warning' ELSE 'error' END)"
_LABEL = "(CASE severity WHEN 'info' THEN 'Info' WHEN 'warning' THEN 'Warning' ELSE 'Critical' END)"

_ISSUE_COLUMNS = "project, path, type_ord, type_name, rule_ord, rule, severity, message"
_SEVERITY_COUNTS = """count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'critical') AS criticals"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


_ON_TYPES = _with(_DERIVED, _raw_issues(), _SUPPRESSED)
_ON_DOCUMENTS = _with(_DOCUMENT_TYPES, _raw_issues(), _SUPPRESSED)

_SUMMARY = f"""SELECT (SELECT count(*) FROM {{files}}) AS total_files, (SELECT count(*) FROM types) AS total_types,
  count(*) AS total_issues, {_SEVERITY_COUNTS} FROM issues"""

_COUNTERS = f"""
counters AS (
  SELECT f.project, f.path, 1 AS total_files, coalesce(t.n, 0) AS total_types, coalesce(i.n, 0) AS total_issues,
         coalesce(i.warnings, 0) AS warnings, coalesce(i.infos, 0) AS infos, coalesce(i.criticals, 0) AS criticals
  FROM type_files f
  LEFT JOIN (SELECT path, count(*) AS n FROM types GROUP BY 1) t ON t.path = f.path
  LEFT JOIN (SELECT path, count(*) AS n, {_SEVERITY_COUNTS} FROM issues GROUP BY 1) i ON i.path = f.path)"""
_COUNTER_SUMS = ", ".join(
    f"sum({name})::BIGINT AS {name}"
    for name in ("total_files", "total_types", "total_issues", "warnings", "infos", "criticals")
)

_BEST = f"""
best AS (
  SELECT * FROM issues WHERE severity <> 'info'
  QUALIFY row_number() OVER (PARTITION BY project, path, type_ord ORDER BY {_RANK} DESC, rule_ord) = 1),
capped AS (
  SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY {_RANK} DESC, type_ord, rule_ord) AS request_rank,
         project || '|' || path || '|' || type_ord || '|' || rule AS request_id
  FROM best)"""

# The theta join as the definition states it: first type of the file whose name is in the message.
_MATCHED = """
matched AS (
  SELECT i.*, t.type_ord AS matched_ord, t.name AS matched_name
  FROM issues i JOIN types t ON t.project = i.project AND t.path = i.path AND contains(i.message, t.name)
  QUALIFY row_number() OVER (PARTITION BY i.path, i.type_ord, i.rule_ord ORDER BY t.type_ord) = 1)"""


def _advice(rule: str, name: str) -> str:
    def text(*lines: str) -> str:
        joined = " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)
        return joined.replace("%s", f"' || {name} || '")

    god = text(
        "1) Root Cause: %s is handling too many responsibilities (UI, Data, Logic).", "2) Refactor Steps:",
        "   - Extract networking logic into a Service class.",
        "   - Move property-heavy state into a specialized Model or ViewModel.",
        "   - Use a Coordinator for navigation logic.",
        "3) Quick Win: Move Delegate/DataSource implementations to extensions.",
    )
    large = text(
        "1) Root Cause: %s exceeds recommended line/method counts for its type.", "2) Refactor Steps:",
        "   - Identify distinct functional blocks and move them to separate files.",
        "   - Use composition instead of inheritance to share logic.",
        "   - Audit methods: if a method doesn't use class state, move it to a Utility.",
        "3) Quick Win: Extract private helper methods into a support structure.",
    )
    heavy = text(
        "1) Root Cause: High property-to-method ratio suggests this %s is a 'Data Bucket'.", "2) Refactor Steps:",
        "   - Convert to a 'Struct' if no identity or reference behavior is needed.",
        "   - Group related properties into nested structs.",
        "   - Move data processing logic into a dedicated Transformer or Manager.",
        "3) Quick Win: Encapsulate related properties into a single 'Configuration' object.",
    )
    generic = text("Local analysis suggests reviewing the SRP (Single Responsibility Principle) for %s.")
    return (
        f"(CASE {rule} WHEN 'GodObject' THEN {god} WHEN 'LargeClass' THEN {large}"
        f" WHEN 'DataHeavyClass' THEN {heavy} ELSE {generic} END)"
    )


_LOCAL_SOURCE = "'Local Heuristics (Qwen2.5-Coder-7B-Instruct Engine)'"

_LOG = """
log AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id, turn, role, text, (conv_id + turn) % 8 AS kind,
         turn % 3 + 1 AS attempt
  FROM conversations),
failures AS (
  SELECT *, CASE WHEN kind BETWEEN 4 AND 6 THEN 'requestFailed' END AS failed,
         CASE kind WHEN 4 THEN 'HTTP 429: busy ' || role WHEN 5 THEN 'HTTP 500: oops ' || role
           WHEN 6 THEN CASE WHEN turn % 2 = 0 THEN 'URL_ERROR -1001: timed out' ELSE 'URL_ERROR -1002: bad address' END
         END AS error_message,
         CASE WHEN kind BETWEEN 4 AND 7 THEN 'requestFailed' END AS chat_failed,
         CASE kind WHEN 4 THEN 'Ollama HTTP 429: {"error":{"message":' || to_json(' busy ' || role || '  ') || '}}'
           WHEN 5 THEN 'Ollama HTTP 500: oops ' || role
           WHEN 6 THEN 'Ollama Error: '
             || CASE WHEN turn % 2 = 0 THEN 'URL_ERROR -1001: timed out' ELSE 'URL_ERROR -1002: bad address' END
           WHEN 7 THEN 'Ollama Error: The data couldn’t be read because it isn’t in the correct format.'
         END AS chat_message,
         CASE WHEN kind <= 1 THEN text END AS chat, CASE WHEN kind = 2 THEN text END AS content
  FROM log)"""

_TURNS = f"""
turns AS (
  SELECT request_id, (['LargeClass','HighMethodDensity','GodObject','DataHeavyClass'])[turn % 4 + 1] AS rule,
         CASE WHEN (conv_id + turn) % 9 <> 0 THEN 'Conv' || conv_id || 'Service' END AS type_name,
         CASE WHEN turn % 2 = 0 THEN 'warning' ELSE 'critical' END AS severity, chat, content, failed, error_message, kind
  FROM failures),
tiers AS (
  SELECT request_id, rule, severity, chat, content, failed, error_message, kind,
         coalesce(type_name, 'UnknownType') AS asked, coalesce(type_name, 'Type') AS subject
  FROM turns)"""


def _cascade(local: bool, cloud: bool) -> str:
    """Tier by tier: which one answers, then its columns."""
    picks = []
    if local:
        picks.append("WHEN length_grapheme(replace(chat, '\r\n', '\n')) > 50 THEN 'chat'")
    if cloud:
        picks.append("WHEN content IS NOT NULL THEN 'content'")
    picks.append("WHEN rule <> 'HighMethodDensity' THEN 'local'")
    return (
        _with(_LOG, _TURNS, f"picked AS (SELECT *, CASE {' '.join(picks)} ELSE 'static' END AS tier FROM tiers)")
        + f"""SELECT request_id, rule, CASE tier WHEN 'local' THEN subject ELSE asked END AS type_name, severity,
  CASE tier WHEN 'chat' THEN 'Local analysis generated by Ollama.'
    WHEN 'content' THEN 'AI analysis generated for ' || rule || '.'
    WHEN 'local' THEN 'Analysis of ' || rule || ' violation.'
    ELSE 'Analysis provided via basic static fallback.' END AS diagnosis,
  CASE tier WHEN 'chat' THEN 'Local (Ollama: coder)' WHEN 'content' THEN 'Cloud (Gemini: flash)'
    WHEN 'local' THEN {_LOCAL_SOURCE} ELSE 'Static Fallback Engine' END AS model_source,
  CASE tier WHEN 'chat' THEN chat WHEN 'content' THEN content WHEN 'local' THEN {_advice('rule', 'subject')}
    ELSE 'Please review the SRP and architectural limits for ' || rule || '. Detailed AI suggestions are currently unavailable.'
  END AS suggested_refactor FROM picked"""
    )


_BLANK = r"[\p{Z}\t\n\x0B\f\r\x{85}]"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _clean(text: str) -> str:
    return _trim(f"replace(replace({text}, '**', ''), '`', '')")


_ADVICE_LINES = f"""
free_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
dressed AS (
  SELECT doc_id, lang, source, i,
         CASE WHEN i % 11 = 4 THEN '**1) Root Cause**: ' || line WHEN i % 11 = 6 THEN '## Refactor STEPS'
           WHEN i % 11 = 8 THEN 'quick win and root cause' WHEN i % 11 = 9 THEN 'Quick Win ' || line
           WHEN i % 3 = 0 THEN '  - `' || line || '` • x ' WHEN i % 3 = 1 THEN '* **' || line || '** ' ELSE '  ' END AS line
  FROM free_lines),
cleaned AS (SELECT *, {_clean('line')} AS clean FROM dressed),
headed AS (
  SELECT *, CASE WHEN contains(lower(clean), 'root cause') THEN 'root_cause'
    WHEN contains(lower(clean), 'refactor steps') THEN 'refactor_steps'
    WHEN contains(lower(clean), 'quick win') THEN 'quick_win' END AS header
  FROM cleaned),
carried AS (
  SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM headed),
section_lines AS (
  SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) - 1 AS line_ord,
         {_trim("replace(replace(replace(clean, '- ', ''), '* ', ''), '• ', '')")} AS line
  FROM carried WHERE header IS NULL AND clean <> '' AND section IS NOT NULL),
compacted AS (
  SELECT doc_id, string_agg('- ' || clean, chr(10) ORDER BY i) FILTER (n <= 8) AS short,
         string_agg('- ' || clean, chr(10) ORDER BY i) FILTER (n <= 20) AS longer,
         string_agg(clean, '|' ORDER BY i) FILTER (n <= 8) AS piped, max(n) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM cleaned WHERE clean <> '') GROUP BY doc_id),
blocks AS (
  SELECT doc_id, string_agg('- ' || line, chr(10) ORDER BY line_ord) FILTER (section = 'root_cause') AS root_cause,
         string_agg('- ' || line, chr(10) ORDER BY line_ord) FILTER (section = 'refactor_steps') AS refactor_steps,
         string_agg('- ' || line, chr(10) ORDER BY line_ord) FILTER (section = 'quick_win') AS quick_win
  FROM section_lines GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM dressed GROUP BY doc_id)"""


def _report(verbose: bool) -> str:
    nl = "chr(10)"
    short = "longer" if verbose else "short"
    hint = "''" if verbose else f"CASE WHEN n >= 8 THEN {nl} || '- ... set AI_VERBOSE=true for full AI text' ELSE '' END"
    raw = f"|| {nl} || 'Raw AI Output' || {nl} || {_clean('w.text')} || {nl}" if verbose else ""

    def block(column: str, title: str) -> str:
        return f"coalesce({nl} || '{title}' || {nl} || {column} || {nl}, '')"

    return _with(_ADVICE_LINES) + f"""SELECT d.doc_id::VARCHAR AS request_id,
  CASE WHEN d.doc_id % 2 = 0 THEN '⚠️ Warning' ELSE '🔴 Critical' END || ' [LargeClass]' || {nl}
  || 'Type       : Doc' || d.doc_id || {nl} || 'Model      : ' || d.source || {nl}
  || 'Diagnosis  : about ' || d.lang || {nl}
  || {block('root_cause', 'Root Cause')} || {block('refactor_steps', 'Refactor Steps')} || {block('quick_win', 'Quick Win')}
  || CASE WHEN coalesce(root_cause, refactor_steps, quick_win) IS NULL
       THEN {nl} || 'Suggestion' || coalesce({nl} || {short}, '') || {hint} || {nl} ELSE '' END {raw} AS report
FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id LEFT JOIN compacted c ON c.doc_id = d.doc_id
JOIN whole w ON w.doc_id = d.doc_id"""


def _prompt(compact: bool) -> str:
    nl = "chr(10)"
    profile = f"""'Structural Profile:' || {nl} || '- Initializers: ' || initializer_count || {nl}
  || '- Computed Properties (Accessors): ' || accessor_count || {nl} || '- Subscripts: ' || subscript_count || {nl}
  || '- Methods: ' || method_count || {nl} || '- Total Lines: ' || line_count || {nl} || {nl}
  || 'Member Map (Relative line ranges):' || {nl}
  || array_to_string(['  - ' || split_part(x, ':', 1) || ' (Lines ' || split_part(x, ':', 2) || ')'
       for x in string_split(members, ';')], {nl})"""
    head = f"'Rule: ' || rule || {nl} || 'Severity: ' || {_EMOJI} || {nl}"
    tail = f"|| {nl} || {nl} || 'Code Snippet:' || {nl} || snippet"
    if compact:
        body = f"""'You are a Swift refactoring assistant.' || {nl} || {head} || 'Message: ' || message || {nl}
  || 'Type: ' || type_name || {nl} || {nl} || {profile} {tail}"""
    else:
        body = f"""'You are a senior Swift architect.' || {nl}
  || 'Analyze this finding and provide concise, actionable refactor guidance.' || {nl} || {nl} || {head}
  || 'Issue message: ' || message || {nl} || 'Type: ' || type_name || {nl} || {nl} || {profile} {tail} || {nl} || {nl}
  || 'Return:' || {nl} || '1) Root cause (1-2 lines)' || {nl} || '2) Refactor steps (3-5 bullets)' || {nl}
  || '3) Quick win (1 bullet)'"""
    source = f"""
source_lines AS (
  SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM (SELECT lang || '/' || doc_id || '.swift' AS path, text FROM documents)),
swift_text AS (
  SELECT path, string_agg(CASE i % 6
    WHEN 0 THEN '    var p' || i || ': Int = ' || i || ', q' || i || ' = "{{ open" // ' || line
    WHEN 1 THEN '    func m' || i || '() {{' || {nl} || '        // {{ ' || line || {nl} || '        let t = "}}", u = 2' || {nl} || '    }}'
    WHEN 2 THEN '    init(a' || i || ': Int, b: Int = 1) {{ }}'
    WHEN 3 THEN '    @objc(c) public var c' || i || ': String {{' || {nl} || '        /* {{ /* }} */ {{ */ "x"' || {nl} || '    }}'
    WHEN 4 THEN '    subscript(i' || i || ': Int) -> Int {{ 0 }}'
    ELSE '    struct N' || i || ' {{' || {nl} || '        let z = 1' || {nl} || '    }}' END, {nl} ORDER BY i) AS body
  FROM source_lines GROUP BY path),
snippets AS (
  SELECT s.path, array_to_string(list_slice(string_split(
    '// {{ file ' || d.doc_id || {nl} || '@MainActor' || {nl} || 'final class Doc' || d.doc_id || {SUFFIX}[d.doc_id % 5 + 1]
    || ': Base, Other {{' || {nl} || body || {nl} || '}}' || {nl} || '// end }}' || {nl}, {nl}), 1, 12), {nl}) AS snippet
  FROM swift_text s JOIN documents d ON s.path = d.lang || '/' || d.doc_id || '.swift')"""
    return _with(_DOCUMENT_TYPES, _raw_issues(large="0", density="1"), _SUPPRESSED, _BEST, source) + f"""SELECT c.path, c.type_ord, rule, {body} AS prompt
FROM capped c JOIN types t ON t.path = c.path AND t.type_ord = c.type_ord JOIN snippets s ON s.path = c.path
WHERE request_rank <= 5"""


_PAGE_FILES = r"""
page_files AS (
  SELECT page_id, 'p' || page_id % 3 AS project,
         (['Pods/','Sources/','my.build/','Build/'])[page_id % 4 + 1] || regexp_replace(url, '^[a-z]+://', '') AS path
  FROM pages)"""

_KIND = "n_nationkey % 5"
def _config_issues() -> str:
    derived = _DERIVED.replace("\ntypes AS (", "\nbuilt_types AS (")
    config = """
types AS (
  SELECT b.*, n_nationkey % 5 AS kind,
         CASE WHEN n_nationkey % 5 = 1 THEN n_nationkey ELSE 10 END AS large,
         CASE WHEN n_nationkey % 5 = 1 THEN n_nationkey ELSE 5 END AS heavy
  FROM built_types b JOIN nation ON n_name = project)"""
    raw = _raw_issues(large="large", heavy="heavy", on=("true", "kind <> 2", "kind <> 3", "true"))
    return _with(derived, config, raw, _SUPPRESSED) + f"SELECT {_ISSUE_COLUMNS} FROM issues"


def _single(rule: str) -> str:
    return _with(_DERIVED, _raw_issues()) + (
        f"SELECT path, type_ord, rule, severity, message FROM raw_issues WHERE rule = '{rule}'"
    )


_PARSED = "SELECT request_id, attempt, {answer} AS answer, {kind} AS error_kind, coalesce({message}, '-') AS error_message FROM failures"


def _parsed(column: str) -> str:
    failed, message = ("chat_failed", "chat_message") if column == "chat" else ("failed", "error_message")
    return _with(_LOG) + _PARSED.format(
        answer=f"coalesce({column}, '-')",
        message=message,
        kind=f"coalesce({failed}, CASE WHEN {column} IS NULL THEN 'invalidResponse' END, '-')",
    )


_HEURISTIC_REPORT = f"""SELECT request_id,
  {_EMOJI} || ' ' || {_LABEL} || ' [' || rule || ']' || chr(10) || 'Type       : ' || type_name || chr(10)
  || 'Model      : ' || {_LOCAL_SOURCE} || chr(10) || 'Diagnosis  : Analysis of ' || rule || ' violation.' || chr(10) || chr(10)
  || CASE rule WHEN 'GodObject' THEN 'Refactor Steps' || chr(10) || '- Extract networking logic into a Service class.' || chr(10)
         || '- Move property-heavy state into a specialized Model or ViewModel.' || chr(10) || '- Use a Coordinator for navigation logic.'
       WHEN 'LargeClass' THEN 'Refactor Steps' || chr(10) || '- Identify distinct functional blocks and move them to separate files.' || chr(10)
         || '- Use composition instead of inheritance to share logic.' || chr(10)
         || '- Audit methods: if a method doesn''t use class state, move it to a Utility.'
       ELSE 'Suggestion' || chr(10) || '- Local analysis suggests reviewing the SRP (Single Responsibility Principle) for ' || type_name || '.'
     END || chr(10) AS report FROM capped"""


def statements() -> dict[str, str]:
    best = _with(_DERIVED, _raw_issues(), _SUPPRESSED, _BEST)
    s: dict[str, str] = {}
    s["category"] = _with(_DERIVED) + (
        "SELECT class_type, count(*) AS types, sum(method_count)::BIGINT AS methods FROM types GROUP BY 1"
    )
    s["rule_large"] = _single("LargeClass")
    s["rule_density"] = _single("HighMethodDensity")
    s["rule_god"] = _single("GodObject")
    s["rule_data_heavy"] = _single("DataHeavyClass")
    s["rule_custom"] = _ON_TYPES + """SELECT rule, severity, count(*) AS issues FROM issues GROUP BY 1, 2
UNION ALL SELECT 'Lopsided', 'warning', count(*) FROM types WHERE property_count * 2 > method_count"""
    s["engine_raw"] = _with(_DERIVED, _raw_issues()) + f"SELECT {_ISSUE_COLUMNS} FROM raw_issues"
    s["engine_suppressed"] = s["engine_antijoin"] = _ON_TYPES + f"SELECT {_ISSUE_COLUMNS} FROM issues"

    s["config_merge"] = f"""SELECT n_name AS project,
  CASE WHEN {_KIND} = 3 THEN '.build,.git,.swiftpm,Build,Carthage,DerivedData,Gen' || n_nationkey || ',Pods'
       ELSE '.build,.git,.swiftpm,Build,Carthage,DerivedData,Pods' END AS folders,
  'true' AS "largeClass_enabled",
  CASE WHEN {_KIND} = 1 THEN n_nationkey::VARCHAR ELSE '10' END AS "largeClass_threshold",
  CASE WHEN {_KIND} = 2 THEN 'false' ELSE 'true' END AS "highMethodDensity_enabled",
  '10' AS "highMethodDensity_threshold",
  CASE WHEN {_KIND} = 3 THEN 'false' ELSE 'true' END AS "godObject_enabled", '-' AS "godObject_threshold",
  'true' AS "dataHeavyClass_enabled",
  CASE WHEN {_KIND} = 1 THEN n_nationkey::VARCHAR ELSE '5' END AS "dataHeavyClass_threshold" FROM nation"""
    s["config_rules"] = _config_issues()

    s["summary_total"] = _ON_TYPES + _SUMMARY.format(files="type_files")
    counters = _with(_DERIVED, _raw_issues(), _SUPPRESSED, _COUNTERS)
    s["summary_by_project"] = counters + f"SELECT project, {_COUNTER_SUMS} FROM counters GROUP BY project"
    s["summary_rollup"] = counters + f"""SELECT coalesce(project, '*') AS project, coalesce(path, '*') AS path,
  CASE grouping(project, path) WHEN 3 THEN 2 ELSE grouping(project, path) END AS level, {_COUNTER_SUMS}
FROM counters GROUP BY ROLLUP (project, path)"""
    s["issues_per_file"] = _ON_TYPES + """SELECT f.project, f.path, f.file_name, count(i.path) AS issue_count
FROM type_files f LEFT JOIN issues i ON i.project = f.project AND i.path = f.path GROUP BY 1, 2, 3"""
    s["leaderboard"] = _ON_TYPES + """SELECT project, path, file_name, count(*) AS issue_count FROM issues
GROUP BY 1, 2, 3 ORDER BY issue_count DESC, project, path LIMIT 10"""
    s["file_head"] = _ON_TYPES + """SELECT project, path, position, type_name, rule, message, issue_count,
  greatest(issue_count - 5, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY type_ord, rule_ord) AS position,
        count(*) OVER (PARTITION BY project, path) AS issue_count FROM issues) WHERE position <= 5"""
    s["severity_views"] = _ON_TYPES + f"""SELECT {_RANK} AS rank, {_LABEL} AS label, {_EMOJI} AS emoji, {_LEVEL} AS level,
  severity <> 'info' AS actionable, count(*) AS issues FROM issues GROUP BY ALL"""
    s["best_per_type"] = best + f"SELECT {_ISSUE_COLUMNS} FROM best"

    s["attribution_lineage"] = _ON_TYPES + "SELECT path, type_ord, rule, type_name AS matched_name FROM issues"
    s["attribution_substring"] = _with(_DERIVED, _raw_issues(), _SUPPRESSED, _MATCHED) + (
        "SELECT path, type_ord, rule, matched_ord, matched_name FROM matched"
    )
    s["report_records"] = _ON_TYPES + (
        f'SELECT file_name AS file, message, rule, {_EMOJI} AS severity, type_name AS "typeName" FROM issues'
    )
    s["report_array"] = s["report_records"]
    s["report_json"] = _ON_TYPES + f"""SELECT '{{"file":"' || file_name || '","message":"' || message || '","rule":"' || rule
  || '","severity":"' || {_EMOJI} || '","typeName":"' || type_name || '"}}' AS line FROM issues"""
    s["report_diagnostic"] = _ON_TYPES + f"""SELECT '/src/' || project || '/' || file_name || ':1: ' || {_LEVEL}
  || ': [typeaudit] ' || message AS line FROM issues"""
    s["report_diagnostic_summary"] = _ON_TYPES + """SELECT 'note: [typeaudit] Analysis complete. Found ' || count(*)
  || ' issues in ' || (SELECT count(*) FROM type_files) || ' files.' AS line FROM issues"""
    dashes, equals = "-" * 40, "=" * 40
    s["report_files"] = _ON_TYPES + f"""
SELECT project, path, 0 AS section, -1 AS type_ord, o AS line_ord, ['', '📄 File: ' || file_name, '{dashes}'][o + 1] AS line
FROM type_files, range(3) r(o)
UNION ALL
SELECT project, path, 1, type_ord, o, ['📦 Type: ' || name || ' [' || class_type || ']',
  '   Inits: ' || initializer_count || ' | Accessors: ' || accessor_count || ' | Subscripts: ' || subscript_count,
  '   Methods: ' || method_count || ' | Properties: ' || property_count || ' | Lines: ' || line_count][o + 1]
FROM types, range(3) r(o)
UNION ALL SELECT DISTINCT project, path, 2, -1, 0, '' FROM issues
UNION ALL SELECT project, path, 3, type_ord, rule_ord, '   ' || {_EMOJI} || ' ' || message FROM issues"""
    s["report_member_map"] = s["report_files"] + """
UNION ALL SELECT project, path, 1, type_ord, 3, '   Members Map:' FROM types WHERE method_count > 0
UNION ALL SELECT project, path, 1, type_ord, 3 + i, '      - m' || i || ' (Lines ' || i || '-' || 2 * i || ')'
FROM (SELECT *, unnest(range(1, method_count + 1)) AS i FROM types)"""
    s["report_custom"] = _ON_TYPES + """SELECT project || ': ' || rule || ' (' || severity || ') x ' || count(*) AS line
  FROM issues GROUP BY project, rule, severity"""
    s["report_summary"] = _ON_TYPES + f""",
top AS (SELECT project, path, file_name, count(*) AS n FROM issues GROUP BY 1, 2, 3 ORDER BY n DESC, project, path LIMIT 10),
totals AS (SELECT count(*) AS n, {_SEVERITY_COUNTS} FROM issues)
SELECT 0 AS section, '-' AS path, o AS line_ord, ['', '🚨 Files With Issues (Top 10)', '{dashes}'][o + 1] AS line FROM range(3) r(o)
UNION ALL SELECT 1, path, 0, '📄 ' || file_name FROM top
UNION ALL SELECT 1, path, position, '   ' || {_EMOJI} || ' ' || message
  FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY type_ord, rule_ord) AS position
        FROM issues SEMI JOIN top USING (project, path)) WHERE position <= 5
UNION ALL SELECT 1, path, 6, CASE WHEN n > 5 THEN '   ...and ' || (n - 5) || ' more issues' ELSE '' END FROM top
UNION ALL SELECT 1, path, 7, '' FROM top WHERE n > 5
UNION ALL SELECT 2, '-', o, ['', '{equals}', '📊 Summary', 'Files scanned: ' || (SELECT count(*) FROM type_files),
  'Types analyzed: ' || (SELECT count(*) FROM types), 'Total issues: ' || n,
  '⚠️ Warnings: ' || warnings || ' | ℹ️ Info: ' || infos || ' | 🔴 Critical: ' || criticals, '{equals}', ''][o + 1]
  FROM totals, range(9) r(o)"""
    s["report_summary"] = s["report_summary"].replace("\n,\ntop AS", ",\ntop AS")

    s["scan_prune"] = _with(_PAGE_FILES) + r"""SELECT page_id, project, path, string_split(path, '/')[-1] AS file_name FROM page_files
WHERE NOT list_has_any(string_split(path, '/'),
  ['.build', '.git', '.swiftpm', 'DerivedData', 'Pods', 'Build', 'Carthage', 'de'])"""
    s["scan_prune_table"] = _with(_PAGE_FILES) + """SELECT page_id, project, path FROM page_files p
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE 'p' || n_nationkey % 3 = p.project
  AND list_contains(string_split(p.path, '/'), (['en', 'fr', 'Build'])[n_nationkey % 3 + 1]))"""
    s["input_check"] = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '/A.swift' WHEN 1 THEN url || '/B.SWIFT'
    WHEN 2 THEN url || '/.swift' ELSE url END AS path, page_id % 7 = 0 AS is_directory,
  CASE WHEN page_id % 7 = 0 OR page_id % 5 IN (0, 1) THEN 'ok'
    ELSE '❌ Single-file input must be a .swift file' END AS input_error FROM pages"""
    s["utf8_decode"] = """SELECT source AS project, lang || '/' || doc_id AS path, doc_id::VARCHAR AS file_name,
  CASE WHEN doc_id % 7 = 0 THEN 'file is not valid UTF-8' ELSE '-' END AS read_error,
  CASE WHEN doc_id % 7 = 0 THEN -1 ELSE length(text) END AS characters FROM documents"""
    s["read_error_flag"] = "SELECT count(*) FILTER (doc_id % 7 = 0) > 0 AS has_errors FROM documents"
    s["line_count"] = r"""SELECT doc_id,
  length(text) - length(regexp_replace(text, '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]', '', 'g')) + 1 AS lines FROM documents"""
    s["snippet"] = """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS snippet
FROM documents"""

    s["tokens"] = _with(_DOCUMENT_TYPES) + """SELECT project, path, 1::BIGINT AS n_class, count(*) FILTER (i % 6 = 5) AS n_struct,
  count(*) FILTER (i % 6 = 1) AS n_func, count(*) FILTER (i % 6 IN (0, 3)) AS n_var,
  count(*) FILTER (i % 6 IN (1, 5)) AS n_let, count(*) FILTER (i % 6 = 2) AS n_init,
  count(*) FILTER (i % 6 = 4) AS n_subscript, count(*) FILTER (i % 6 > 0) + 1 AS n_open,
  count(*) FILTER (i % 6 > 0) + 1 AS n_close, (sum(lines) + 5)::BIGINT AS line_breaks
FROM doc_parts GROUP BY project, path"""
    s["types"] = _with(_DOCUMENT_TYPES) + """SELECT project, path, file_name, type_ord, class_type, name, method_count, property_count,
  line_count, initializer_count, subscript_count, accessor_count, members FROM types"""
    s["members"] = _with(_DOCUMENT_TYPES) + f"""SELECT project, path, 0 AS type_ord, 'Doc' || doc_id || {SUFFIX}[doc_id % 5 + 1] AS type_name,
  i AS member_ord, member AS name, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM doc_members
UNION ALL SELECT project, path, (i + 1) // 6, 'N' || i, 0, 'z', 1, 1 FROM doc_lines WHERE i % 6 = 5"""
    s["extracted_issues"] = _ON_DOCUMENTS + f"SELECT {_ISSUE_COLUMNS} FROM issues"
    s["extracted_leaderboard"] = _ON_DOCUMENTS + """SELECT project, path, file_name, count(*) AS issue_count FROM issues
GROUP BY 1, 2, 3 ORDER BY issue_count DESC, project, path LIMIT 20"""
    s["extracted_summary"] = s["stream_summary"] = _ON_DOCUMENTS + _SUMMARY.format(files="documents")

    s["request_selection"] = best + (
        "SELECT request_id, path, type_name, rule, severity, request_rank FROM capped WHERE request_rank <= 5"
    )
    s["request_selection_by_name"] = _with(_DERIVED, _raw_issues(), _SUPPRESSED, _MATCHED) + f""",
best AS (SELECT * FROM matched WHERE severity <> 'info'
  QUALIFY row_number() OVER (PARTITION BY project, path, matched_name ORDER BY {_RANK} DESC, type_ord, rule_ord) = 1),
capped AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY {_RANK} DESC, type_ord, rule_ord) AS request_rank FROM best)
SELECT c.path, matched_name AS type_name, c.type_ord, rule, severity, request_rank, t.method_count
FROM capped c JOIN types t ON t.path = c.path AND t.type_ord = c.matched_ord WHERE request_rank <= 5"""
    s["request_selection_by_name"] = s["request_selection_by_name"].replace("\n,\nbest AS", ",\nbest AS")
    s["prompt_standard"], s["prompt_compact"] = _prompt(False), _prompt(True)

    s["heuristics_local"] = _with(_DERIVED, _raw_issues()) + f"""SELECT project || '|' || path || '|' || type_ord || '|' || rule AS request_id,
  rule, type_name, severity, 'Analysis of ' || rule || ' violation.' AS diagnosis, {_LOCAL_SOURCE} AS model_source,
  {_advice('rule', 'type_name')} AS suggested_refactor FROM raw_issues"""
    s["heuristics_augmented"] = best + f"""SELECT request_id, rule, type_name, severity,
  'Analysis complete using model at audit.mlmodelc.' AS diagnosis,
  'Local Model (Qwen2.5-Coder-7B-Instruct)' AS model_source,
  'Model says: ' || message || chr(10) || chr(10) || {_advice('rule', 'type_name')} AS suggested_refactor FROM capped"""
    s["static_advice"] = best + """SELECT request_id, rule, type_name, severity,
  'Analysis provided via basic static fallback.' AS diagnosis, 'Static Fallback Engine' AS model_source,
  'Please review the SRP and architectural limits for ' || rule || '. Detailed AI suggestions are currently unavailable.'
    AS suggested_refactor FROM capped"""
    s["provider_plugin"] = best + """SELECT request_id, rule || ' in ' || type_name AS diagnosis, 'word counter' AS model_source,
  len(string_split(message, ' ')) || ' words' AS suggested_refactor FROM capped"""

    s["provider_ledger"] = best + """SELECT request_id, upper(project || ' ' || rule || ' ' || severity) AS diagnosis, 'ledger' AS model_source,
  length(project || ' ' || rule || ' ' || severity)::VARCHAR AS suggested_refactor FROM capped"""

    s["chat_extract"], s["content_extract"] = _parsed("chat"), _parsed("content")
    s["retry_triage"] = _with(_LOG) + """SELECT request_id, attempt, coalesce(failed, 'invalidResponse') AS error_kind,
  kind = 4 OR (kind = 6 AND turn % 2 = 0) AS retryable, (kind = 4 OR (kind = 6 AND turn % 2 = 0)) AND attempt < 3 AS retry,
  CASE WHEN (kind = 4 OR (kind = 6 AND turn % 2 = 0)) AND attempt < 3 THEN 1 << (attempt - 1) ELSE 0 END AS backoff_seconds
FROM failures WHERE content IS NULL"""
    s["final_attempts"] = _with(_LOG) + """SELECT conv_id::VARCHAR AS request_id, turn AS attempt, coalesce(chat, '-') AS answer,
  coalesce(chat_failed, CASE WHEN chat IS NULL THEN 'invalidResponse' END, '-') AS error_kind,
  coalesce(chat_message, '-') AS error_message
FROM failures QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""
    turns = _with(_LOG, _TURNS)
    s["advice_good"] = turns + """SELECT request_id, rule, asked AS type_name, severity, 'Local analysis generated by Ollama.' AS diagnosis,
  'Local (Ollama: coder)' AS model_source, chat AS suggested_refactor FROM tiers WHERE chat IS NOT NULL"""
    s["advice_failed"] = turns + """SELECT request_id, rule,
  CASE WHEN kind = 3 THEN 'timeout' ELSE coalesce(failed, 'invalidResponse') END AS error_kind,
  CASE WHEN kind = 3 THEN 'AI request timed out.' WHEN failed IS NOT NULL THEN 'AI request failed: ' || error_message
    ELSE 'AI provider returned an invalid response.' END AS error_text FROM tiers WHERE content IS NULL"""
    s["cascade_local_first"] = _cascade(local=True, cloud=True)
    s["cascade_local_only"] = _cascade(local=True, cloud=False)
    s["cascade_cloud_first"] = _cascade(local=False, cloud=True)

    s["advice_sections"] = _with(_ADVICE_LINES) + (
        "SELECT doc_id::VARCHAR AS request_id, section, line_ord, line FROM section_lines"
    )
    s["advice_report"], s["advice_report_verbose"] = _report(False), _report(True)
    s["advice_report_heuristic"] = best + _HEURISTIC_REPORT
    s["advice_report_files"] = best + f"""SELECT project, path, place AS position,
  CASE WHEN place = 0 THEN '🤖 AI Suggestions for ' || regexp_replace(path, '^.*/', '') WHEN place % 2 = 1 THEN repeat('-', 40) ELSE report END AS line
FROM (SELECT project, path, report, unnest(CASE WHEN n = 1 THEN [0, 1, 2, 3] ELSE [2 * n, 2 * n + 1] END) AS place
  FROM (SELECT c.project, c.path, r.report, row_number() OVER (PARTITION BY c.project, c.path ORDER BY c.type_ord, c.rule_ord) AS n
    FROM capped c JOIN ({_HEURISTIC_REPORT}) r ON r.request_id = c.request_id))"""
    s["advice_after_failure"] = best + f"""SELECT request_id, rule, type_name, severity, 'Analysis of ' || rule || ' violation.' AS diagnosis,
  'Local Heuristics (Fallback from Qwen2.5-Coder-7B-Instruct)' AS model_source, {_advice('rule', 'type_name')} AS suggested_refactor FROM capped"""
    newlines = r"length(text) - length(regexp_replace(text, '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]', '', 'g'))"
    s["types_nested"] = f"""SELECT doc_id::VARCHAR AS path, 0 AS type_ord, 'T' || doc_id AS name, 1 AS method_count, 2 AS property_count,
  (10 + 2 * ({newlines}))::INTEGER AS line_count FROM documents"""
    lines = "length(text) - length(replace(text, chr(10), '')) + 1"
    s["types_unclosed"] = f"""SELECT doc_id::VARCHAR AS path, 0 AS type_ord, 'U' || doc_id AS name, ({lines})::INTEGER AS method_count,
  1 AS property_count, (2 + {lines})::INTEGER AS line_count FROM documents"""
    s["advice_confidence"] = """SELECT conv_id, turn, length_grapheme(marked) AS characters, length_grapheme(marked) > 50 AS is_confident
  FROM (SELECT conv_id, turn, regexp_replace(substr(replace(text, '\r\n', '\n'), 1, 45 + (conv_id % 12)::INTEGER), '([aeiou])', '\\1' || chr(769), 'g') AS marked
    FROM conversations)"""
    s["compact_lines"] = _with(_ADVICE_LINES) + (
        "SELECT d.doc_id::VARCHAR AS request_id, coalesce(piped, '') AS compact FROM documents d"
        " LEFT JOIN compacted c ON c.doc_id = d.doc_id"
    )
    return s
