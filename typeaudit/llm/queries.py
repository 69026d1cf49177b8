"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeaudit.llm import (
    collocations, decontaminate, lm_score, merkle, near_dedup, packing, quality_rules, repeats, sharding, token_counts, token_output, url_filter,
    warc,
)
from typeaudit.session import materialize

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark, sf_dir):
    """Links at a similarity of 0.8 on four-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(shingle=4))


@query
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.judged(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op2_lm_score(spark, sf_dir):
    return lm_score.scores(table(spark, sf_dir, "documents"))


@query
def op3_suffix_array_dedup(spark, sf_dir):
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_token_output(spark, sf_dir):
    """Writes the shards of all documents; where each sequence lies."""
    return token_output.materialize_order(table(spark, sf_dir, "documents"))


@query
def op5_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = packing.pack_apart(docs)
    return found.select("row.doc_id", "n_tokens", "piece", "piece_tokens", "bin", "bin_offset")


#: Shards of the production layout; the first ones stand on larger machines.
SHARDS = {f"shard-{i:03d}": 2 if i < 16 else 1 for i in range(96)}


@query
def op6_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return sharding.place(docs, SHARDS, fallback=["source", "lang", "n_chars"]).select("row.doc_id", "slot", "shard")


RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


@query
def op7_url_filter(spark, sf_dir):
    """The list: canonical URLs of which a tracked or paged variant was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    tracked = pages.where(url.rlike(r"[?&](utm_source|ref)="))
    listed = tracked.select(url_filter.canonical(url_filter.host_of(url), url_filter.path_of(url)).alias("canonical"))
    return url_filter.judge(pages, listed, RULES).select("row.page_id", "host", "path", "rule", "verdict")


SQL["op7_url_filter"] = r"""
WITH parsed AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), named AS (
  SELECT *, CASE WHEN host <> '' THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/+|\.html)$', '') END AS canonical
  FROM parsed
), rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), ranked AS (
  SELECT n.page_id, n.url, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.host || r.path) DESC) AS k
  FROM named n JOIN rules r
    ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(url, '[?&](utm_source|ref)=') AND canonical IS NOT NULL
)
SELECT n.page_id, n.host, n.path, r.rule,
  coalesce(r.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n
LEFT JOIN ranked r ON r.page_id = n.page_id AND r.k = 1
LEFT JOIN listed l ON l.canonical = n.canonical
"""


@query
def op8_token_counts(spark, sf_dir):
    # One row for each distinct length; it is read twice, the texts are encoded once.
    lengths = materialize(token_counts.histogram(table(spark, sf_dir, "documents")), "lengths")
    return token_counts.by_limit(lengths)


@query
def op11_merkle_manifest(spark, sf_dir):
    """Trees of fanout 8 over each language; every third row or so is tampered with and must not verify."""
    docs = table(spark, sf_dir, "documents")
    doc_id, text = F.col("doc_id"), F.col("text")

    def leaf(of: Column) -> Column:
        return merkle.digest(*[merkle.field(c) for c in (doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), of)])

    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, leaf(lowered))
    kept = {"doc_id": doc_id, "tampered": tampered}
    found = merkle.manifest(docs, leaf(text), F.col("lang"), doc_id, kept).proofs
    shown = F.coalesce("row.tampered", "leaf")
    proved = found.select(
        "row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(shown, F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 12) -> str:
    """Both trees level by level; ``levels`` of them hold 8 ** levels rows."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    fields = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    eight = ", ".join(["0"] * 8)
    parts = [
        f"""crcs AS (SELECT DISTINCT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT],
             list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), {eight}], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
           FROM documents WHERE doc_id IS NOT NULL)""",
        f"""leaves AS (SELECT d.doc_id, d.lang, sha256({fields.replace("doc_id", "d.doc_id")} || {field.format("text")}) AS leaf,
             CASE WHEN crc % 3 = 0 THEN sha256({fields.replace("doc_id", "d.doc_id")} || {field.format(lowered)}) END AS tampered
           FROM documents d LEFT JOIN crcs c ON c.doc_id = d.doc_id)""",
        """numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)""",
        "a0 AS (SELECT lang AS g, pos, leaf AS h FROM numbered)",
    ]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{name}m{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k})"""
            )
            parts.append(
                f"""{name}{k + 1} AS (SELECT g, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}m{k} WHERE n > 1
                  GROUP BY g, pos // 8 UNION ALL SELECT g, pos, h FROM {name}m{k} WHERE n = 1)"""
            )
            parts.append(
                f"""{name}s{k} AS (SELECT x.g, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
                  coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r, any_value(x.n) > 1 AS up
                  FROM {name}m{k} x JOIN {name}m{k} y ON x.g IS NOT DISTINCT FROM y.g AND x.pos // 8 = y.pos // 8 GROUP BY x.g, x.pos)"""
            )

    climb("a")
    parts.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, g AS lang FROM a{levels})")
    parts.append("subroots AS (SELECT lang, pos AS place, h AS subroot FROM b0)")
    climb("b")
    parts.append(
        f"""f0 AS (SELECT n.doc_id, n.lang, n.leaf, n.pos, s.subroot, s.place, (SELECT h FROM b{levels}) AS root, '' AS proof,
          coalesce(n.tampered, n.leaf) AS h FROM numbered n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang)"""
    )
    steps = [(f"as{k}", "f.lang IS NOT DISTINCT FROM s.g", "pos") for k in range(levels)]
    steps += [(f"bs{k}", "s.g = 0", "place") for k in range(levels)]
    for k, (side, same, pos) in enumerate(steps):
        other = "place" if pos == "pos" else "pos"
        parts.append(
            f"""f{k + 1} AS (SELECT doc_id, lang, leaf, CASE WHEN up THEN f.{pos} // 8 ELSE f.{pos} END AS {pos}, f.{other}, subroot, root,
              CASE WHEN up THEN proof || l || r ELSE proof END AS proof, CASE WHEN up THEN sha256(l || f.h || r) ELSE f.h END AS h
              FROM f{k} f JOIN {side} s ON {same} AND f.{pos} = s.pos)"""
        )
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root,
      h = root AS verified FROM f{len(steps)}"""


SQL["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_warc(spark, sf_dir):
    """Archives of all pages, written and read back."""
    folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op12_warc"] = """
WITH held AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST) AS k,
    first_value(page_id) OVER (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST) AS last_id FROM held
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN last_id END AS refers_to
FROM ranked
"""


@query
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL["op13_collocations"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS id, words FROM (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words FROM (
      SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(words) > 0
), words AS (
  SELECT lang, id, unnest(words) AS w, unnest(range(len(words))) AS i FROM pieces
), windows AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY id ORDER BY i)
), counts AS (
  SELECT lang, phrase, m, count(*)::HUGEINT AS f FROM (
    SELECT lang, 1 AS m, w1 AS phrase FROM windows
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM windows WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM windows WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM windows WHERE w4 IS NOT NULL) GROUP BY ALL
), totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30
), cuts AS (
  SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) t(k) WHERE k < m
), rated AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, r.f AS r, 2000000 * c.f // (h.f + r.f) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000 * c.f // (h.f + r.f), k) AS best
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest
), inner_phrases AS (
  SELECT lang, f, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM candidates, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(s) WHERE s < m AND i + s - 1 <= m
), held AS (SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY ALL
), ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.lang ORDER BY score DESC, a DESC, r.phrase) AS rank
  FROM rated r LEFT JOIN held h ON h.lang = r.lang AND h.phrase = r.phrase
  WHERE best = 1 AND (longer IS NULL OR 100 * longer < 80 * a)
)
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
