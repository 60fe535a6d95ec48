"""Scan and commit filters and text functions, on pages, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import mining as M
from millrace.operators.redaction import redacted_json
from millrace.plans.registry import query
from millrace.session import table

# events as commits: the type gives author and message, the value whether it is a merge
_COMMITS = """WITH commits AS (
    SELECT event_id, ts, event_type = 'purchase' AND value > 50 AS merge, CASE WHEN user_id % 17 = 0 THEN 'renovate[bot]' WHEN user_id % 17 = 1 THEN NULL ELSE 'user' || user_id END AS author,
           CASE WHEN event_id % 11 = 0 THEN 'Template for ' || event_type WHEN event_id % 11 = 1 THEN 'fix TYPO' ELSE 'change ' || event_type END AS message FROM events),
    kept AS (SELECT * FROM commits WHERE NOT merge AND coalesce(author, '') NOT IN ('dependabot[bot]', 'pre-commit-ci[bot]', 'github-actions[bot]', 'renovate[bot]')
             AND NOT regexp_matches(lower(coalesce(message, '')), 'wip|temp|revert|formatting only|lint only|style only|typo'))"""


def _commits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    author = F.when(F.col("user_id") % 17 == 0, "renovate[bot]").when(F.col("user_id") % 17 == 1, F.lit(None)).otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
    message = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("Template for "), "event_type")).when(F.col("event_id") % 11 == 1, F.lit("fix TYPO")).otherwise(F.concat(F.lit("change "), "event_type"))
    return e.select("event_id", "ts", ((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("merge"), author.alias("author"), message.alias("message"))


def _kept(spark, sf_dir):
    return _commits(spark, sf_dir).where(M.commit_passes(F.col("merge"), F.col("author"), F.col("message")))


@query("commit_f1_cutoff", "SELECT event_id FROM events WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-15 00:00:00'")
def cutoff(spark, sf_dir):
    import datetime

    return table(spark, sf_dir, "events").where(M.before_cutoff(F.col("ts"), datetime.datetime(2024, 1, 15))).select("event_id")


@query("commit_f2_cascade", _COMMITS + " SELECT event_id, author, message FROM kept")
def cascade(spark, sf_dir):
    return _kept(spark, sf_dir).select("event_id", "author", "message")


@query("commit_t3_first_pairs", _COMMITS + " SELECT event_id FROM kept ORDER BY ts, event_id LIMIT 500")
def first_pairs(spark, sf_dir):
    return M.first_pairs(_kept(spark, sf_dir), ["ts", "event_id"], 500).select("event_id")


@query(
    "commit_j2_pairs",
    """WITH v AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, round(value) AS content FROM events)
       SELECT a.user_id, a.event_type, a.event_id AS before_id, b.event_id AS after_id FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.n = a.n + 1
       WHERE a.content IS NOT NULL AND b.content IS NOT NULL AND a.content <> b.content""",
)
def changed_pairs(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("before_id"), F.round("value").alias("before"), F.lead("event_id").over(order).alias("after_id"), F.lead(F.round("value")).over(order).alias("after"))
    return rows.where(M.content_passes(F.col("before"), F.col("after"))).select("user_id", "event_type", "before_id", "after_id")


_SEGMENTS = "string_split(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '/')"


@query("scan_s1_paths", f"SELECT page_id, url FROM pages WHERE NOT (list_has_any({_SEGMENTS}, ['de', 'es']) OR ends_with(url, '_pb2.py'))")
def paths(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    renamed = F.regexp_replace(F.regexp_replace(path, "^de(/|$)", "vendor$1"), "^es(/|$)", "third_party$1")
    return table(spark, sf_dir, "pages").where(~M.excluded_path(renamed)).select("page_id", "url")


@query("scan_s3_generated", "SELECT page_id, contains(substring(html, 1, 4096), '# DO NOT EDIT') AS generated, contains(substring(html, 1, 4096), 'cookie') AS marked FROM pages")
def generated(spark, sf_dir):
    head = F.substring("html", 1, M.GENERATED_CHARS)
    return table(spark, sf_dir, "pages").select("page_id", M.generated(F.col("html")).alias("generated"), F.contains(head, F.lit("cookie")).alias("marked"))


@query("scan_s4_roots", "SELECT page_id FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/(en|fr)/')")
def roots(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    return table(spark, sf_dir, "pages").where(M.under_roots(path, F.array(F.lit("en"), F.lit("fr/")))).select("page_id")


@query("scan_s5_new_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_keys(spark, sf_dir):
    return M.new_keys(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("text_x1_unix_lines", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, ' and ', E' \r\n'), E'\r\n?', E'\n', 'g'), '(?m)[ \t\f\v]+$', '', 'g')) AS h FROM documents")
def unix_lines(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(" and "), F.lit(" \r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.unix_lines(text), 256).alias("h"))


@query("text_x2_pragmas", r"SELECT doc_id, sha256(regexp_replace(replace(text, ' of ', '  # noqa: E1 of '), '[ \t]*#[ \t]*(?:type:[ \t]*ignore|noqa|fmt:|pylint:|mypy:)[^\n]*', '', 'g')) AS h FROM documents")
def pragmas(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(" of "), F.lit("  # noqa: E1 of "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.without_trailing_pragmas(text), 256).alias("h"))


@query(
    "text_x3_pragma_lines",
    r"""SELECT doc_id, sha256(array_to_string(list_filter(string_split(replace(text, '. ', E'.\n  # fmt: '), chr(10)), lambda l: NOT regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '^# (type: ignore|noqa|fmt:|pylint:|mypy:)')), chr(10))) AS h FROM documents""",
)
def pragma_lines(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n  # fmt: "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.without_pragma_lines(text), 256).alias("h"))


_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


@query("text_x4_emails", rf"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '', 'g'), '[ \t]+', ' ', 'g'), '\s+$', '')) AS h FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(X.EMAIL)).select("doc_id", F.sha2(X.without_emails(F.col("text")), 256).alias("h"))


@query("text_x9_tokens", r"SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM documents)")
def token_counts(spark, sf_dir):
    w = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(
    "text_x14_redacted",
    rf"SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN '<redacted: too_long>' ELSE sha256(regexp_replace(regexp_replace(text, '\b[0-9a-fA-F]{{32,}}\b', '<redacted: hex_token>', 'g'), '{_EMAIL}', '<redacted: email>', 'g')) END AS h FROM documents",
)
def redacted(spark, sf_dir):
    r = X.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(r == "<redacted: too_long>", r).otherwise(F.sha2(r, 256)).alias("h"))


@query("text_x19_file_names", "SELECT DISTINCT replace(source || '/' || lang, '/', '__') || '.json' AS audit_file, regexp_replace(source || '/' || lang || '?', '[^A-Za-z0-9._-]', '_', 'g') AS safe_name FROM documents")
def file_names(spark, sf_dir):
    repo = F.concat_ws("/", "source", "lang")
    return table(spark, sf_dir, "documents").select(X.audit_file_name(repo).alias("audit_file"), X.safe_file_name(F.concat(repo, F.lit("?"))).alias("safe_name")).distinct()


@query("text_x20_major_version", r"SELECT o_orderkey, coalesce(TRY_CAST(nullif(regexp_extract(v, '^v?(\d{1,9})(?:\.|$)', 1), '') AS INT), -1) AS major FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_custkey || '.2' WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_custkey::VARCHAR END AS v FROM orders)")
def major_version(spark, sf_dir):
    custkey = F.col("o_custkey").cast("string")
    v = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("v"), custkey, F.lit(".2"))).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(custkey)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.major_version(v).alias("major"))


@query(
    "redact_x14_nested",
    rf"""SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN '<redacted: too_long>'
                            ELSE regexp_replace(regexp_replace(text, '\b[0-9a-fA-F]{{32,}}\b', '<redacted: hex_token>', 'g'), '{_EMAIL}', '<redacted: email>', 'g') END AS note,
               CASE WHEN doc_id % 2 = 1 THEN '<redacted: source>' WHEN length(text) > 256 THEN text[1:256] || '…' ELSE text END AS code,
               sha256(doc_id::VARCHAR) AS chunk_id, '<redacted: hex_token>' AS other FROM documents WHERE text IS NOT NULL""",
)
def redacted_payload(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    digest = F.sha2(F.col("doc_id").cast("string"), 256)
    payload = F.to_json(F.struct(F.struct(F.array("text").alias("note"), digest.alias("chunk_id"), digest.alias("other")).alias("of"), F.col("text").alias("code")))
    out = d.select("doc_id", redacted_json(payload, F.when(F.col("doc_id") % 2 == 1, "info").otherwise("debug")).alias("p"))
    found = out.select("doc_id", F.from_json("p", "of struct<note: array<string>, chunk_id: string, other: string>, code string").alias("p"))
    return found.select("doc_id", F.col("p.of.note")[0].alias("note"), "p.code", "p.of.chunk_id", "p.of.other")


@query(
    "ids_x21_time_ordered",
    "SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS millis, true AS of_version_7 FROM events WHERE ts IS NOT NULL",
)
def time_ordered(spark, sf_dir):
    # the column has no zone and is read as UTC, whatever the session's zone
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")
    ids = table(spark, sf_dir, "events").where(F.col("ts").isNotNull()).select("event_id", X.time_ordered_id(at).alias("id"))
    good = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.select("event_id", F.translate(F.substring("id", 1, 13), "-", "").alias("millis"), good.alias("of_version_7"))
