"""One query for each operator, over its whole table with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.llm import (
    chat_format,
    chunk_dedup,
    decontaminate,
    html_text,
    language,
    lexical_search,
    ngram_join,
    packing,
    pii,
    prefix_trie,
    secret_ledger,
    sharding,
    token_counts,
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that must give the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query()
def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


_ESCAPED = "replace(replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3')"


@query(
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), marked AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
               AS loss_sha256,
           sum(length({_ESCAPED.format("text")}) + CASE WHEN before = role THEN length('<+>')
               ELSE length('<s>[' || {_ESCAPED.format("role")} || ']' || '</s>') END)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
    """
)
def op2_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    both = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")),
                             F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(F.lit(-1).alias("conv_id"), both.alias("t")).select("conv_id", "t.turn", "t.role", text)
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(extra)))


@query(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op4_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.find_copies(read(spark, sf_dir, "documents"))


@query()
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.link_documents(read(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op3_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


@query()
def op5_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.with_clusters(read(spark, sf_dir, "documents")))


@query()
def op7_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


_SECRET_PATTERNS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]+", 24, 0),
]
_SECRET_MATCHES = " UNION ALL ".join(
    f"SELECT row, '{kind}' AS kind, {i} AS rank, {least} AS least, string_split_regex(t, '{p}') AS gaps, "
    f"regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS counted FROM d"
    for i, (kind, p, least, group) in enumerate(_SECRET_PATTERNS)
)


@query(
    f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({_SECRET_MATCHES}),
    e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
    f AS (
        SELECT row, kind, rank, length(hits[i]) AS size,
               list_sum(list_transform(gaps[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
        FROM e WHERE length(counted[i]) >= least
    ),
    g AS (
        SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(concat_ws(':', kind, start::BIGINT, (start + size)::BIGINT), ',' ORDER BY start, rank) AS spans
        FROM f GROUP BY row
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (row)
    """
)
def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_ledger.scan_versions(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secret_ledger.listing(F.col("found"))
    digest = F.sha2(spans.cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, spans.alias("spans"))


@query()
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("key")


@query()
def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), key=b"a key of the query's own")


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_SMALL}, '{_TERMS}') AS terms FROM documents
    ), held AS (SELECT row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
    whole AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM held),
    q AS (
        SELECT item_id, term, count(*) AS repeats
        FROM (SELECT item_id, unnest(regexp_extract_all({_SMALL}, '{_TERMS}')) AS term FROM benchmark) GROUP BY item_id, term
    ), tf AS (
        SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM held)
        WHERE term IN (SELECT term FROM q) GROUP BY row, term
    ), weight AS (
        SELECT term, floor(1000 * ln((2 * (SELECT N FROM whole) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term
    ), score AS (
        SELECT item_id, row, sum(repeats * w * ((1000000000 * tf) // (1000 * tf
                   + 8 * (100 - 75 + (75 * n * (SELECT N FROM whole)) // (SELECT L FROM whole)))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN held USING (row) GROUP BY item_id, row
    ), ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
               doc_id, score
        FROM score JOIN held USING (row) WHERE score > 0
    )
    SELECT * FROM ranked WHERE rank <= 10
    """
)
def op11_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_CRC32 = """
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
        lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END))
"""


@query(
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(text, '') AS text,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS digest
        FROM conversations WHERE conv_id IS NOT NULL
    ), original AS (
        SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests,
               list(strlen(text) ORDER BY turn NULLS FIRST, digest) AS sizes
        FROM turns GROUP BY conv_id
    ), heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM original),
    rebuilt AS (
        SELECT o.conv_id, coalesce(b.digests[1:h], []) || o.digests[h + 1:] AS digests,
               coalesce(b.sizes[1:h], []) || o.sizes[h + 1:] AS sizes
        FROM original o JOIN heads USING (conv_id) LEFT JOIN original b ON b.conv_id = heads.base
    ), prefixes AS (
        SELECT conv_id, d AS depth, digests[1:d] AS path, sizes[d] AS size, d = len(digests) AS final
        FROM (SELECT *, unnest(range(0, len(digests) + 1)) AS d FROM rebuilt)
    ), nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256
        FROM prefixes GROUP BY path, depth
    ), kin AS (
        SELECT p.path, p.depth, p.conv_id AS parent_conv_id, count(c.path) AS n_children
        FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path GROUP BY ALL
    ), below AS (
        SELECT n.path[1:d] AS path, sum((n_convs - 1) * size)::BIGINT AS saved_tokens,
               count(*) FILTER (n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes JOIN kin USING (path, depth)) n GROUP BY 1
    )
    SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, k.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
    FROM nodes n JOIN kin k ON k.path = n.path AND k.depth = n.depth JOIN below b ON b.path = n.path
    LEFT JOIN kin p ON n.depth = p.depth + 1 AND p.path = n.path[1:p.depth]
    """
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefix_trie.sequences(read(spark, sf_dir, "conversations"))
    return prefix_trie.build(prefix_trie.spliced(convs, stride=5, most=9))


@query()
def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"), shards=16)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
