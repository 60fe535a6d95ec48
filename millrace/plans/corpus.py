"""Corpus building: exact and near duplicates, splits, leakage, audits, content identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import audit, dedup, splits
from millrace.operators.digests import ordered_digest
from millrace.plans.registry import query
from millrace.session import settle, table, widened

ASSIGNMENTS = splits.numbered_assignments("src", 12, 4, 4)
_SPLIT = "CASE WHEN regexp_extract(source, '[0-9]+')::INT < 12 THEN 'train' WHEN regexp_extract(source, '[0-9]+')::INT < 16 THEN 'val' ELSE 'test' END"
_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _texts(spark, sf_dir):
    """Documents with text, for maps that cost far more than moving it."""
    return widened(_docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "text"))


def _split_docs(spark, sf_dir):
    return splits.assign_splits(_docs(spark, sf_dir), "source", ASSIGNMENTS)


def _split_texts(spark, sf_dir):
    docs = widened(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return splits.assign_splits(docs, "source", ASSIGNMENTS)


@query(
    "dedup_d1_exact",
    """SELECT doc_id, source, sha256(text) AS content_sha256 FROM documents
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def exact(spark, sf_dir):
    kept, _ = dedup.exact_dedup(_docs(spark, sf_dir), "text", "doc_id")
    return kept.select("doc_id", "source", F.sha2("text", 256).alias("content_sha256"))


@query(
    "dedup_d1_removed",
    "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1",
)
def removed(spark, sf_dir):
    _, gone = dedup.exact_dedup(_docs(spark, sf_dir), "text", "doc_id")
    return gone.select("doc_id", "source")


@query(
    "dedup_d2_shingles",
    """SELECT doc_id, len(g) AS n_shingles, list_min(g) AS least, list_max(g) AS most FROM (
         SELECT doc_id, CASE WHEN length(text) < 5 THEN [text] ELSE list_distinct(list_transform(range(1, length(text) - 3), lambda i: substring(text, i, 5))) END AS g
         FROM documents WHERE length(text) > 0)""",
)
def shingles(spark, sf_dir):
    rows = _docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", X.char_shingles(F.col("text")).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_shingles"), F.array_min("g").alias("least"), F.array_max("g").alias("most"))


@query(
    "dedup_d3_shingle_hash",
    """WITH g AS (SELECT doc_id, CASE WHEN length(text) < 5 THEN [text] ELSE list_distinct(list_transform(range(1, length(text) - 3), lambda i: substring(text, i, 5))) END AS g FROM documents WHERE length(text) > 0),
            h AS (SELECT doc_id, ('0x' || sha1(unnest(g))[1:8])::BIGINT AS h FROM g)
       SELECT doc_id, min(h) AS least, sum(h)::BIGINT AS total FROM h GROUP BY doc_id""",
)
def shingle_hash(spark, sf_dir):
    rows = dedup.shingle_hashes(_texts(spark, sf_dir), "doc_id", "text")
    return rows.select("doc_id", F.array_min("hashes").alias("least"), F.aggregate("hashes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _minhash_sql(n):
    """sigs(doc_id, s): products of up to 93 bits are folded modulo 2^61 - 1 in halves, once a different hash."""
    a, b = dedup.hash_pairs(n)
    pairs = ", ".join(f"({i}, {x >> 32}::UBIGINT, {x & 0xFFFFFFFF}::UBIGINT, {y}::UBIGINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)))
    fold = lambda v: f"((({v}) & {dedup.PRIME}) + (({v}) >> 61))"
    return f"""WITH RECURSIVE pairs(i, ah, al, b) AS (VALUES {pairs}),
       c AS (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0),
       g AS (SELECT doc_id, CASE WHEN len(c) < 5 THEN [array_to_string(c, '')] ELSE list_distinct(list_transform(range(1, len(c) - 3), lambda k: c[k] || c[k + 1] || c[k + 2] || c[k + 3] || c[k + 4])) END AS g FROM c),
       h AS (SELECT doc_id, ('0x' || sha1(unnest(g))[1:8])::UBIGINT AS h FROM g),
       products AS (SELECT h, i, ah * h AS x, al * h AS y, b FROM (SELECT DISTINCT h FROM h) CROSS JOIN pairs),
       folded AS (SELECT h, i, {fold("x")} AS x, {fold("y")} AS y, b FROM products),
       sums AS (SELECT h, i, {fold(f"(x >> 29) + ((x & {(1 << 29) - 1}) << 32) + y + b")} AS v FROM folded),
       hashed AS (SELECT h, list(CASE WHEN v >= {dedup.PRIME} THEN v - {dedup.PRIME} ELSE v END ORDER BY i) AS v FROM sums GROUP BY h),
       slots AS (SELECT doc_id, i, min(v)::BIGINT AS v FROM (SELECT doc_id, unnest(v) AS v, unnest(range({n})) AS i FROM h JOIN hashed USING (h)) GROUP BY ALL),
       sigs AS (SELECT doc_id, list(v ORDER BY i) AS s FROM slots GROUP BY doc_id)"""


@query("dedup_d5_minhash", _minhash_sql(128) + " SELECT doc_id, array_to_string(s, ',') AS signature FROM sigs")
def minhash(spark, sf_dir):
    return dedup.signatures(_texts(spark, sf_dir), "doc_id", "text").select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


_COMPONENTS = (
    _minhash_sql(128)
    + """, classes AS (SELECT s, min(doc_id) AS rep FROM sigs GROUP BY s),
       links AS (SELECT x.rep AS a, y.rep AS b FROM classes x JOIN classes y ON x.rep <> y.rep
                 WHERE list_sum(list_transform(list_zip(x.s, y.s), lambda p: (p[1] = p[2])::INT)) >= 0.85 * 128),
       reach(node, root) AS (SELECT rep, rep FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
       roots AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
       placed AS (SELECT g.doc_id, r.component FROM sigs g JOIN classes c USING (s) JOIN roots r ON r.node = c.rep)"""
)


@query("dedup_d7_lsh", _COMPONENTS + " SELECT doc_id, component FROM placed")
def lsh(spark, sf_dir):
    return dedup.lsh_dedup(_texts(spark, sf_dir), "doc_id", "text")


@query(
    "dedup_d8_report",
    _COMPONENTS
    + """, n AS (SELECT count(*) AS total, count(DISTINCT text) + max((text IS NULL)::INT) AS uniq, max((coalesce(text, '') = '')::INT) AS blank FROM documents),
         r AS (SELECT total, uniq, blank + (SELECT count(DISTINCT component) FROM placed) AS retained FROM n)
         SELECT total, total - uniq AS exact, uniq - retained AS near, retained, (total - retained)::DOUBLE / total AS dedup_rate FROM r""",
)
def dedup_report(spark, sf_dir):
    """Counts of digests and of components. No text is moved: near duplicates are found among all rows, as equal texts have equal signatures."""
    docs = _docs(spark, sf_dir)
    unique = docs.select(dedup.digest(F.col("text")).alias("digest")).distinct()
    near = dedup.lsh_dedup(_texts(spark, sf_dir), "doc_id", "text").select(F.lit(False).alias("blank"), "component")
    blank = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select(F.lit(True).alias("blank"), F.lit(None).cast("long").alias("component"))
    return dedup.report(docs.select("doc_id"), unique, settle(near.union(blank).distinct(), "near"))


_LEAKS = f"""WITH docs AS (SELECT doc_id, {_SPLIT} AS split, list_distinct({_TOKENS}) AS w FROM documents),
       words AS (SELECT doc_id, unnest(w) AS t FROM docs),
       hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM words a JOIN words b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
       leaks AS (SELECT x.split AS split_a, p.a, y.split AS split_b, p.b, p.n::DOUBLE / (len(x.w) + len(y.w) - p.n) AS jaccard
                 FROM hits p JOIN docs x ON x.doc_id = p.a JOIN docs y ON y.doc_id = p.b
                 WHERE list_position(['train', 'val', 'test'], x.split) < list_position(['train', 'val', 'test'], y.split)
                   AND p.n::DOUBLE / (len(x.w) + len(y.w) - p.n) >= 0.85)"""


@query("split_d9_leakage", _LEAKS + " SELECT * FROM leaks")
def leakage(spark, sf_dir):
    return splits.detect_leakage(_split_texts(spark, sf_dir), "doc_id", "text", "split")


@query("split_d10_resolved", _LEAKS + " SELECT split, count(*) AS n FROM docs WHERE doc_id NOT IN (SELECT b FROM leaks) GROUP BY split")
def resolved(spark, sf_dir):
    return splits.without_leaks(_split_texts(spark, sf_dir), "doc_id", "text", "split").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_j3_classes",
    _LEAKS
    + """, c AS (SELECT doc_id, split, min(doc_id) OVER (PARTITION BY list_sort(w)) AS class FROM docs WHERE len(w) > 0),
         p AS (SELECT DISTINCT x.class AS class, y.class AS other FROM leaks JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b),
         e AS (SELECT class, other FROM p UNION SELECT other, class FROM p)
         SELECT doc_id, class AS class_id, (SELECT count(*) FROM e WHERE e.class = c.class) AS n_links, doc_id IN (SELECT b FROM leaks) AS forestalled FROM c""",
)
def leak_classes(spark, sf_dir):
    """Every document with tokens: its class (named by its lowest document), the classes of other splits that it leaks to, and whether an earlier split has it."""
    members, links = splits.leaks(_split_texts(spark, sf_dir), "doc_id", "text", "split")
    names = members.groupBy("class").agg(F.min("id").alias("class_id"))
    linked = links.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    gone = splits.leaking_rows(members, links).select("id", F.lit(True).alias("gone"))
    rows = members.join(names, "class").join(linked, "class", "left").join(gone, "id", "left")
    return rows.select(F.col("id").alias("doc_id"), "class_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("gone", F.lit(False)).alias("forestalled"))


@query(
    "split_d11_spanning",
    f"""SELECT cluster, count(DISTINCT split) AS n_splits, count(*) AS members FROM (SELECT sha256(text) AS cluster, {_SPLIT} AS split FROM documents)
        GROUP BY cluster HAVING count(DISTINCT split) > 1""",
)
def spanning(spark, sf_dir):
    return splits.spanning_clusters(_split_docs(spark, sf_dir).select(F.sha2("text", 256).alias("cluster"), "split"), "cluster", "split")


@query("split_d12_assign", f"SELECT doc_id, source, {_SPLIT} AS split FROM documents")
def assigned(spark, sf_dir):
    return _split_docs(spark, sf_dir).select("doc_id", "source", "split")


@query(
    "split_d13_lock",
    f"""SELECT by_repo, sha256(by_repo) AS split_hash FROM (
          SELECT '{{' || array_to_string(list_sort(list('"' || source || '": "' || split || '"')), ', ') || '}}' AS by_repo FROM (SELECT DISTINCT source, {_SPLIT} AS split FROM documents))""",
)
def lock(spark, sf_dir):
    return splits.split_lock(_split_docs(spark, sf_dir).select("source", "split"), "source", "split")


@query(
    "content_d14_ids",
    """SELECT doc_id, sha256(source || ':' || lang || ':' || doc_id || ':' || text) AS chunk_id FROM documents""",
)
def content_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string"), "text"), 256).alias("chunk_id"))


@query(
    "content_d14_pool_hash",
    "SELECT lang, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS pool_hash FROM documents GROUP BY lang",
)
def pool_hash(spark, sf_dir):
    return ordered_digest(_docs(spark, sf_dir), "lang", "doc_id", out="pool_hash")


@query(
    "pool_d15_sample",
    "SELECT item_id FROM (SELECT DISTINCT item_id FROM benchmark) ORDER BY sha256('7|' || item_id), item_id LIMIT 25",
)
def pool(spark, sf_dir):
    from millrace.operators.sequences import build_pool

    return build_pool(table(spark, sf_dir, "benchmark"), "item_id", 25, 7)


@query(
    "pool_d16_seed",
    "SELECT item_id, ('0x' || sha256(item_id || ':' || 7)[1:8])::BIGINT AS seed FROM benchmark",
)
def pool_seed(spark, sf_dir):
    digest = F.sha2(F.concat(F.col("item_id").cast("string"), F.lit(":7")), 256)
    return table(spark, sf_dir, "benchmark").select("item_id", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("seed"))


_HEX = r"\b[0-9a-fA-F]{32,}\b"
#: Stand-ins on prose: a chunk "does not parse" if it has a table bar, and is over the cap above 512 tokens.
_AUDIT = f"""WITH chunks AS (
         SELECT source, doc_id, len({_TOKENS}) AS n_tokens, lang AS file_path, contains(text, ' | ') AS parse_failed, len({_TOKENS}) > 512 AS over_cap,
                row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate, CASE WHEN lang IS NULL THEN 'none' ELSE 'MIT' END AS license,
                len(regexp_extract_all(text, '{_HEX}')) AS n_secrets FROM documents),
       audits AS (
         SELECT *, compile_ok >= 0.95 AS compile_gate, duplication_rate < 0.30 AS duplication_gate, license IN ('PSF-2.0', 'BSD-3-Clause', 'MIT', 'Apache-2.0') AS license_gate, secrets = 0 AS secrets_gate,
                compile_ok >= 0.95 AND duplication_rate < 0.30 AND license IN ('PSF-2.0', 'BSD-3-Clause', 'MIT', 'Apache-2.0') AND secrets = 0 AS gates_pass
         FROM (SELECT *, 1 - parse_fail_rate AS compile_ok FROM (
           SELECT source, count(*) FILTER (NOT parse_failed) AS chunk_count, coalesce(trunc(median(n_tokens) FILTER (NOT parse_failed)), 0)::BIGINT AS median_tokens,
                  count(DISTINCT nullif(file_path, '')) AS file_count, sum(parse_failed::INT)::DOUBLE / count(*) AS parse_fail_rate,
                  sum(over_cap::INT)::DOUBLE / (count(*) FILTER (NOT parse_failed) + sum(over_cap::INT)) AS over_cap_rate,
                  sum(duplicate::INT)::DOUBLE / count(*) AS duplication_rate, min(license) AS license, sum(n_secrets)::BIGINT AS secrets
           FROM chunks GROUP BY source)))"""


def _audits(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n_tokens = F.size(X.tokens(F.col("text")))
    first = docs.groupBy(F.sha2("text", 256).alias("_d")).agg(F.min("doc_id").alias("_first"))
    chunks = docs.select(
        "source", "doc_id", n_tokens.alias("n_tokens"), F.col("lang").alias("file_path"), F.contains("text", F.lit(" | ")).alias("parse_failed"), (n_tokens > 512).alias("over_cap"),
        F.sha2("text", 256).alias("_d"), F.when(F.col("lang").isNull(), "none").otherwise("MIT").alias("license"), F.regexp_count("text", F.lit(_HEX)).alias("n_secrets"),
    )
    return audit.audit(chunks.join(first, "_d").withColumn("duplicate", F.col("doc_id") != F.col("_first")), "source")


@query("audit_a1_repos", _AUDIT + " SELECT * FROM audits")
def audits(spark, sf_dir):
    return _audits(spark, sf_dir)


@query(
    "audit_f12_failures",
    _AUDIT
    + " SELECT source, gate FROM (UNPIVOT (SELECT source, compile_gate, duplication_gate, license_gate, secrets_gate FROM audits) ON compile_gate, duplication_gate, license_gate, secrets_gate INTO NAME gate VALUE passed) WHERE NOT passed",
)
def failures(spark, sf_dir):
    return audit.gate_failures(_audits(spark, sf_dir), "source")


@query("audit_a3_intents", "SELECT source, to_json(map_from_entries(list((i, n) ORDER BY i))) AS per_intent FROM (SELECT source, coalesce(nullif(lang, 'en'), 'unknown') AS i, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def intents(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("intent", F.nullif(F.col("lang"), F.lit("en")))
    return audit.intent_counts(docs, "source", "intent").select("source", F.to_json("per_intent").alias("per_intent"))


_PLANTED = "text || CASE doc_id % 15 WHEN 0 THEN ' AKIA' || upper(md5(doc_id::VARCHAR)[1:16]) WHEN 5 THEN ' ghp_' || md5(doc_id::VARCHAR) || 'zzzz' WHEN 10 THEN ' eyJ' || doc_id || '.a-b.c_d' ELSE '' END"


@query(
    "audit_x15b_secrets",
    " UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern_name, unnest(regexp_extract_all({_PLANTED}, '{pattern.replace(',255}', ',}')}'))[1:8] AS match_preview FROM documents" for name, pattern in X.SECRETS),
)
def secrets(spark, sf_dir):
    """All four patterns: a fifth of the texts gets a key of one of three kinds that the tables lack."""
    key = F.when(F.col("doc_id") % 15 == 0, F.concat(F.lit(" AKIA"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16))))
    key = key.when(F.col("doc_id") % 15 == 5, F.concat(F.lit(" ghp_"), F.md5(F.col("doc_id").cast("string")), F.lit("zzzz"))).when(F.col("doc_id") % 15 == 10, F.concat(F.lit(" eyJ"), F.col("doc_id").cast("string"), F.lit(".a-b.c_d")))
    planted = F.concat("text", F.coalesce(key, F.lit("")))
    return audit.secret_hits(_docs(spark, sf_dir).select("doc_id", planted.alias("text")), "doc_id", "text")


@query("audit_x15b_clean", "SELECT source, count(*) AS n FROM documents WHERE NOT (" + " OR ".join(f"regexp_matches(text, '{p.replace(',255}', ',}')}')" for _, p in X.SECRETS) + ") GROUP BY source")
def clean(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hits = audit.secret_hits(docs, "doc_id", "text").select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_BOILER = "regexp_matches(text, '(?i)all rights reserved|this work is licensed')"


@query("audit_f14_boilerplate", f"SELECT source, count(*) FILTER ({_BOILER}) AS boilerplate, count(*) AS n FROM documents GROUP BY source")
def boilerplate(spark, sf_dir):
    hit = F.col("text").rlike("(?i)all rights reserved|this work is licensed")
    return _docs(spark, sf_dir).groupBy("source").agg(F.count_if(hit).alias("boilerplate"), F.count(F.lit(1)).alias("n"))
