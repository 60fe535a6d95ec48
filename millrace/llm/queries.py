"""The queries opN_<name> over the driver's tables, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, embeddings, language, lines, media, mixing, ngrams, packing, repeats, runs, search, sentences, urls
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add


_SAYS = "</s>[INST] ok [/INST]"


@query(
    "op1_chat_format",
    f"""WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '{_SAYS}' UNION ALL SELECT -7, 1, 'assistant', '{_SAYS}'),
        escaped AS (
          SELECT *, length('<s>[INST] ' || ' [/INST]' || '</s>') + (SELECT sum(
              length(x) + (length(x) - length(replace(x, '\\', '')))
              + (length(x) - length(replace(x, '<s>', ''))) // 3 + (length(x) - length(replace(x, '</s>', ''))) // 4
              + (length(x) - length(replace(x, '[INST]', ''))) // 6 + (length(x) - length(replace(x, '[/INST]', ''))) // 7)
              FROM (VALUES (role), (text)) v(x)) AS chars
          FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id""",
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back: turns and loss mask are parsed out of the formatted bytes."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAYS).alias("text")
    )
    return chat_digests(chat.format_chats(turns.unionByName(extra)))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its fragments. SHA-256 takes a conversation's bytes in order, so
    its fragments stream through one task, one at a time; only the digests' states are held."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "fragment")
    template = chat.ChatTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list | None = None

        def done(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            rows = []
            for conv, text, begins, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(done(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, raw = chat.read_back(text, template), text.encode()
                state[1] += len(turns)
                state[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                masked = "".join(template.unescape(raw[a:b].decode()) for a, b in zip(begins, ends, strict=True))
                state[3] += len(masked)
                state[4].update(masked.encode())
                state[5] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _DIGESTS, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(state), _DIGESTS, strict=True)], names=names)

    return dealt.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_DIGESTS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


@query("op5_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL. A page is labelled by the labels row of its number: bad if toxic or of quality 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict", "n_rules")


@query(
    "op6_source_mix",
    """WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
        sums AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
                        [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
                 FROM sized GROUP BY source),
        caps AS (SELECT *, 2.0::DOUBLE * source_size AS most FROM sums),
        levels AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                              - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(weight) OVER (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
                   FROM caps),
        goals AS (SELECT source, source_size, n,
                         coalesce(least(most, max(CASE WHEN level * weight <= most THEN level END) OVER () * weight), most) AS target FROM levels),
        split AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goals),
        ranked AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.copies, d.source,
                          s.target - s.copies * s.source_size AS room,
                          CASE WHEN s.source_size > 0 THEN s.target / s.source_size - s.copies ELSE 0.0::DOUBLE END AS share, s.n,
                          (('0x' || md5('mix|' || coalesce(d.doc_id::VARCHAR, ''))[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
                   FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source),
        valued AS (SELECT *, CASE WHEN size > 0 AND share > 0 THEN u / (1.0::DOUBLE - u) / (share / (1.0::DOUBLE - share) * sqrt(source_size::DOUBLE / n / size)) END AS q FROM ranked),
        running AS (SELECT *, CASE WHEN q IS NOT NULL THEN
                        sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) - size END AS so_far FROM valued)
        SELECT doc_id, size, source_size, target,
               ((copies + CASE WHEN q IS NOT NULL AND so_far + size::DOUBLE / 2 <= room THEN 1 ELSE 0 END) * size)::BIGINT AS taken
        FROM running""",
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_media_columns")
def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "feature")
    return media.media_columns(table(spark, sf_dir, "documents"), columns=digests)


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.train(docs, ~F.col("held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op4_embedding_dedup",
    """WITH RECURSIVE units AS (
          SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach(vec_id, root) AS (
          SELECT vec_id, vec_id FROM units UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id),
        roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
        SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
        FROM roots r""",
)
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op8_ngram_join",
    """WITH RECURSIVE tokens AS (
          SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
        grams AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM tokens),
        parts AS (SELECT doc_id, unnest(g) AS s FROM grams),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM parts a JOIN parts b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM grams UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id),
        roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
        SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, r.component_id FROM grams g JOIN roots r USING (doc_id)""",
)
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


@query(
    "op3_line_dedup",
    """WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
        lines AS (SELECT doc_id, i - 1 AS line, p[i] AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
        tokens AS (SELECT doc_id, line, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM lines),
        sets AS (
          SELECT doc_id, line, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM tokens WHERE len(w) > 0),
        firsts AS (SELECT g, min((doc_id, line)) AS first, row_number() OVER () AS id FROM sets GROUP BY g),
        grams AS (SELECT id, unnest(g) AS s FROM firsts),
        shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM grams a JOIN grams b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
        later AS (SELECT DISTINCT x.id FROM shared JOIN firsts x ON x.id = a JOIN firsts y ON y.id = b
                  WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n) AND y.first < x.first),
        gone AS (SELECT doc_id, line FROM sets JOIN firsts USING (g) WHERE (doc_id, line) <> first OR id IN (SELECT id FROM later)),
        kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
                        coalesce(string_agg(l.t, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS text
                 FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(k.text) AS kept_sha256
        FROM documents LEFT JOIN kept k USING (doc_id)""",
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's remaining lines."""
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), (F.col("n_removed") > 0).alias("has_repeats"))


@query("op11_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; the digests are of the ids and of the text that comes back."""
    encoded = sentences.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = sentences.decode(encoded, out="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts of a tenth of the documents, by the hash of the key, repeat their words from a place on; a null key repeats nothing."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    own = own.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words, planted ones included, and the digest of what is left without repeats."""
    found = runs.periodic_runs(with_periods(table(spark, sf_dir, "documents"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op13_lexical_search",
    """WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        freq AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM freq GROUP BY doc_id),
        sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM freq, sums GROUP BY term, docs),
        scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
                   FROM asked JOIN freq USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), sums GROUP BY ALL),
        ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 50""",
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
