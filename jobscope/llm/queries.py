"""One registered query per operator, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import (
    chat,
    embedding_dedup,
    hard_negatives,
    html_text,
    language,
    lexical_search,
    mixing,
    packing,
    simhash,
    token_counts,
    topk,
    toxicity,
    warc,
)
from jobscope.llm.common import held_out
from jobscope.session import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

NEIGHBOURS = 5
QUERY_STEP = 50
ANCHOR_STEP = 100
SCALE = 256.0


def _query(oracle: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


@_query()
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, folder, "documents"))


def vocabulary() -> tuple[str, str]:
    """The tokenizer's file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@_query()
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(load(spark, folder, "documents"), *vocabulary())
    # only the digest of the ids goes on; the ids themselves are not moved
    kept = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(kept)


@_query(
    """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s QUALIFY rank <= 5
    """
)
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    return topk.top_k(rows, F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS, scale=SCALE)


@_query(
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    ), ok AS (
        SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
        WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0
    ), links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM v
        UNION
        SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), smallest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(c.n, 0) AS n_links, s.component_id, v.vec_id = s.component_id AS kept
    FROM v JOIN smallest s ON v.vec_id = s.a LEFT JOIN counts c ON v.vec_id = c.a
    """
)
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, folder, "embeddings"))


@_query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    model = toxicity.fit(documents, load(spark, folder, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
    FROM m
    """
)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    headers, payloads = warc.records(load(spark, folder, "pages"))
    read = warc.read_records(warc.reconstruct(headers, payloads), with_payload=False)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query()
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    text = html_text.main_text(load(spark, folder, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@_query()
def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.per_row(mixing.mix(load(spark, folder, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _escaped(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


@_query(
    f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), n AS (
        SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
               sum(length({_escaped("role")}) + length({_escaped("text")})
                   + {len(chat.OPEN + chat.MIDDLE + chat.CLOSE)}) OVER w AS written
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(written) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
    FROM n GROUP BY conv_id
    """
)
def op9_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.examples(turns.unionByName(extra)))


@_query()
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents")
    profiles = language.fit(documents)
    found = language.identify(documents.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


@_query()
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(load(spark, folder, "documents"), vocabulary()[0])


@_query(
    """
    WITH v AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, v.vec_id AS vec_id, a.label = v.label AS same,
               CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
        FROM v a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0
    ), p AS (
        SELECT anchor_id, vec_id, score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.vec_id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
           s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5
    """
)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    relabelled = rows.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(relabelled, F.col("vec_id") % ANCHOR_STEP == 0, scale=int(SCALE))


@_query(
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents WHERE text IS NOT NULL
    ), totals AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS all_terms FROM d WHERE len(words) > 0),
    i AS (
        SELECT row_number() OVER () AS item_no, item_id, list_distinct(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS words
        FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
    ), asked AS (SELECT item_no, item_id, unnest(words) AS term FROM i),
    tf AS (
        SELECT no, doc_id, n, term, count(*) AS tf
        FROM (SELECT no, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM d)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    impact AS (
        SELECT no, doc_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
            * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // all_terms))) AS impact
        FROM tf JOIN df USING (term), totals
    ), scored AS (
        SELECT item_no, item_id, no, doc_id, CAST(sum(impact) AS BIGINT) AS score
        FROM asked JOIN impact USING (term) GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
           doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10
    """
)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
