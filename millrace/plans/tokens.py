"""Token ids, commit walks and sequence ids, on documents, events and conversations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.functions import canonical
from millrace.functions import text as X
from millrace.operators import sequences as S
from millrace.operators import tokens as K
from millrace.operators import walk as W
from millrace.operators.normalise import embedding_input
from millrace.plans.registry import query
from millrace.session import table, widened

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')"


@query("tokens_x11_encoded")
def encoded(spark, sf_dir):
    """Every document's ids and its frame of 512; tested against the vocabulary's own library over whole tables."""
    ids = K.encode(widened(table(spark, sf_dir, "documents").select("doc_id", "text")))
    framed = K.token_ids(F.col("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.size(framed).alias("n_framed"))


@query("tokens_x12_round_trip", "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents")
def round_trip(spark, sf_dir):
    """Every document encoded, framed without a cap, and decoded: the text comes back."""
    ids = K.encode(widened(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    whole = F.concat(F.array(F.lit(2)), F.col("ids"), F.array(F.lit(3), F.lit(0), F.lit(0)))
    back = K.decode(ids.select("doc_id", whole.alias("ids")))
    return back.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "tokens_f9_over_cap",
    f"""SELECT doc_id, len(w) > 126 AS over_cap, CASE WHEN len(w) > 126 THEN 0 ELSE 128 END AS n_framed,
               CASE WHEN len(w) > 126 THEN 0 ELSE 5 + list_sum(list_transform(w, lambda t: length(t) + 15))::BIGINT END AS total
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
)
def over_cap(spark, sf_dir):
    """Words as tokens, their lengths as ids, so that SQL can state them: a row over the cap stays, with no ids."""
    ids = F.transform(X.tokens(F.col("text")), lambda t: F.length(t) + 15)
    framed = K.token_ids(F.col("ids"), 128)
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", K.over_cap(F.col("ids"), 128).alias("over_cap"), framed.alias("framed"))
    return rows.select("doc_id", "over_cap", F.size("framed").alias("n_framed"), F.aggregate("framed", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(
    "tokens_f9_counts",
    f"SELECT lang, count(*) AS n, count(*) FILTER (len({_WORDS}) > 126) AS over_cap, count(*) FILTER (len({_WORDS}) = 0) AS blank FROM documents GROUP BY lang",
)
def over_cap_counts(spark, sf_dir):
    """How many rows of each language the cap empties, and how many had nothing."""
    ids = F.transform(X.tokens(F.col("text")), lambda t: F.length(t) + 15)
    rows = table(spark, sf_dir, "documents").select("lang", ids.alias("ids"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(K.over_cap(F.col("ids"), 128)).alias("over_cap"), F.count_if(F.size("ids") == 0).alias("blank"))


# ---- the walk through commits

_BASE = "SELECT event_id, user_id, ts, value, event_type, (event_id % (SELECT count(*) FROM documents)) AS at FROM events"


def _side(key: str, word: str, value: str) -> str:
    return f"'def a' || {key} || '():' || chr(10) || '    return ' || {word} || {value} || chr(10)"


def commits(spark, sf_dir):
    """events as commits: each changes three files, whose sources hold a word of a document of that number.

    File 0 is Python and changes when the event's value is above 50; file 1 is no Python; file 2
    is renamed, and has lost its earlier side every fifth time, or does not parse every seventh.
    """
    docs = table(spark, sf_dir, "documents")
    places = docs.count()
    words = docs.select("doc_id", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8).alias("word"))
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % places).join(words, "doc_id", "left")
    key, word = F.col("event_id").cast("string"), F.concat(F.lit("'"), F.coalesce("word", F.lit("")), F.lit("'"))

    def side(tail, first="def a"):
        return F.concat(F.lit(first), key, F.lit("():\n    return "), word, F.lit(tail), F.lit("\n"))

    odd = F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(side(""))
    new = F.when(F.col("event_id") % 7 == 0, F.lit("def (\n")).otherwise(F.concat(side("  # noqa"), side(" * 2", "def b")))

    def file(old_path, new_path, before, source):
        return F.struct(F.lit(old_path).cast("string").alias("old_path"), F.lit(new_path).alias("new_path"), before.alias("source_before"), source.alias("source"))

    files = F.array(
        file(None, "a.py", side(""), F.when(F.col("value") > 50, side(" * 3")).otherwise(side(""))),
        file("b.txt", "b.txt", side(""), side(" + 'x'")),
        file("c.py", "", F.concat(odd, side(" + 'y'", "def b")), new),
    )
    author = F.when(F.col("user_id") % 17 == 0, "renovate[bot]").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string")))
    message = F.when(F.col("event_id") % 11 == 0, F.lit("fix TYPO")).otherwise(F.concat(F.lit("change "), "event_type"))
    parents = F.when(F.col("event_id") > 0, F.array(F.concat(F.lit("p"), key)))
    return e.select(
        F.lit("r").alias("repo"), W.position_of(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp"), F.col("event_id")).alias("position"), F.concat(F.lit("h"), key).alias("hash"), parents.alias("parents"), author.alias("author"),
        F.col("ts").cast("timestamp_ntz").alias("author_date"), (F.col("event_type") == "purchase").alias("merge"), message.alias("message"), files.cast(W.FILES).alias("modified_files"),
    )


_WALK = f"""WITH base AS ({_BASE}), commits AS (
      SELECT b.*, chr(39) || coalesce(substring(md5(coalesce(d.text, '')), 1, 8), '') || chr(39) AS word, b.event_id::VARCHAR AS k, epoch_us(ts) * 1000 + b.event_id % 1000 AS position
      FROM base b LEFT JOIN documents d ON d.doc_id = b.at
      WHERE event_type <> 'purchase' AND user_id % 17 <> 0 AND b.event_id % 11 <> 0 AND ts < TIMESTAMP '2024-01-15 00:00:00'),
    pairs AS (
      SELECT *, 0 AS f, 'a.py' AS file_path, 'a' || k AS node_qualname, {_side("k", "word", "''")} AS source_before, {_side("k", "word", "' * 3'")} AS source_after FROM commits WHERE value > 50
      UNION ALL
      SELECT *, 2, 'c.py', 'b' || k, {_side("k", "word", "' + ''y'''").replace("'def a'", "'def b'")}, {_side("k", "word", "' * 2'").replace("'def a'", "'def b'")} FROM commits WHERE event_id % 5 <> 0 AND event_id % 7 <> 0)
    SELECT 'r' AS repo, CASE WHEN event_id > 0 THEN 'p' || k ELSE repeat('0', 40) END AS commit_sha_before, 'h' || k AS commit_sha_after, file_path, node_qualname, source_before, source_after, 'change ' || event_type AS commit_message
    FROM pairs """


@query("commit_s7_walk", _WALK)
def whole_walk(spark, sf_dir):
    """All pairs of the history: cutoff, merges, bots, messages, files, nodes and contents, in that order."""
    return W.as_pair(W.walk(commits(spark, sf_dir), max_pairs=None, cutoff=datetime.datetime(2024, 1, 15)))


@query("commit_s7_first_pairs", _WALK + " ORDER BY position, f, node_qualname LIMIT 300")
def limited_walk(spark, sf_dir):
    """The first 300 pairs: slices of 100, 200, 400 ... commits until there are enough."""
    return W.as_pair(W.walk(commits(spark, sf_dir), max_pairs=300, cutoff=datetime.datetime(2024, 1, 15), first_slice=100))


# ---- content ids of sequences, and what goes into the encoder


def _windows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.transform(X.tokens(F.col("text")), lambda t: F.length(t) + 15).alias("ids"))
    return S.build_sequences(rows, ["conv_id"], "turn", "ids", 2, 1, 1)


@query(
    "content_d14_sequences",
    f"""WITH t AS (SELECT conv_id, turn, list_transform({_WORDS}, lambda t: length(t) + 15) AS ids FROM conversations),
        r AS (SELECT conv_id, ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS start, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE len(ids) > 0)
      SELECT a.conv_id, a.start, sha256('{{"context_ids":[[' || array_to_string(a.ids, ',') || '],[' || array_to_string(b.ids, ',') || ']],"file_path":"caf\\u00e9/' || a.conv_id
             || '","repo":"a\\"b","target_ids":[' || array_to_string(c.ids, ',') || ']}}') AS sequence_id
      FROM r a JOIN r b ON a.conv_id = b.conv_id AND b.start = a.start + 1 JOIN r c ON a.conv_id = c.conv_id AND c.start = a.start + 2 WHERE a.start <= a.n - 4""",
)
def sequence_ids(spark, sf_dir):
    """The content id of every window of turns."""
    path = F.concat(F.lit("café/"), F.col("conv_id").cast("string"))
    own = canonical.sequence_id(F.lit('a"b'), path, F.col("context"), F.col("target"))
    return _windows(spark, sf_dir).select("conv_id", F.col("start").cast("long").alias("start"), own.alias("sequence_id"))


@query(
    "embed_r11_front",
    """SELECT doc_id, doc_id % 4 = 1 OR (doc_id % 4 = 2 AND length(text) > 4000) AS refused FROM documents WHERE text IS NOT NULL AND (doc_id % 4 <> 2 OR length(text) > 4000 OR length(text) < 200)""",
)
def embed_front(spark, sf_dir):
    """A module per document: with its text as a string, or one that does not parse. Texts of more than 4000 characters are over the cap, those under 200 are not."""
    text, kind = F.col("text"), F.col("doc_id") % 4
    body = F.to_json(F.struct(text.alias("t")))
    literal = F.substring(body, 6, F.length(body))
    source = F.when(kind == 1, F.lit("def (")).when(kind == 2, F.concat(F.lit("def f():\n    return "), F.regexp_replace(literal, r"\}$", ""), F.lit("\n"))).otherwise(F.concat(F.lit("x = "), F.col("doc_id").cast("string"), F.lit("\n")))
    docs = table(spark, sf_dir, "documents").where(text.isNotNull() & ((kind != 2) | (F.length(text) > 4000) | (F.length(text) < 200)))
    out = embedding_input(docs.select("doc_id", source.alias("source")))
    return out.select("doc_id", F.col("token_ids").isNull().alias("refused"))
