"""Registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    ball_tree,
    exact_dedup,
    html_templates,
    language_id,
    merkle,
    ngram_join,
    packing,
    sentencepiece_viterbi,
    sharding,
    suffix_dedup,
    token_store,
    topk_search,
    toxicity,
)
from parley.llm.tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SHARDS = 24


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "op3_exact_dedup",
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
         g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"), 256)
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), digest).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("carried").alias("text_sha256")
    )


@query("op5_token_store")
def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(read(spark, sf_dir, "documents"), public_path())
    return token_store.read_documents(store)


def fold(parts: int) -> Column:
    """Remainder of crc32 of the id as text."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % parts


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    model = toxicity.train(docs.where(~held_out), read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.select(
        "doc_id",
        "held_out",
        F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op2_topk_search")
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(read(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_templates.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to: the same text, so the checksums agree."""
    path = public_path("piece_bpe_32k.model")
    back = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(read(spark, sf_dir, "documents"), path), path)
    crc = F.crc32(F.encode("text", "utf-8"))
    return back.select("doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"), crc.alias("text_crc32"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "_language.lang_pred", "_language.score")


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), public_path())
    return packed.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "rebalanced_shard",
    )


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _item_sql(field: str) -> str:
    return f"CASE WHEN {field} IS NULL THEN '-' ELSE strlen({field}::VARCHAR) || ':' || {field} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_item_sql(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# crc32 bit by bit: every byte is mixed in and followed by eight steps.
_CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), list_resize([]::UBIGINT[], 8, 0::UBIGINT)), "
    "lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::UBIGINT)"
)


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS k, doc_id, coalesce('+' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
            CASE WHEN {_CRC_SQL} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered
        FROM documents
    ),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
    ),
    lv AS (
        SELECT 0 AS level, tree, pos, n, leaf AS h FROM leaves
        UNION ALL
        SELECT level + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY level, tree, pos // 8, n
    ),
    roots AS (SELECT tree, h, level, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
    up AS (
        SELECT 0 AS level, pos, n, h FROM roots
        UNION ALL
        SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, pos // 8, n
    ),
    own AS (
        SELECT k, leaves.tree, roots.pos AS place, roots.level AS height, leaves.pos, leaves.n FROM leaves JOIN roots USING (tree)
    ),
    path AS (
        SELECT k, lv.level AS step, own.pos // (8 ** lv.level)::BIGINT AS me, lv.pos AS other, h FROM own JOIN lv USING (tree)
        WHERE lv.n > 1 AND lv.pos // 8 = own.pos // (8 ** (lv.level + 1))::BIGINT
        UNION ALL
        SELECT k, height + up.level, place // (8 ** up.level)::BIGINT, up.pos, h FROM own, up
        WHERE up.n > 1 AND up.pos // 8 = place // (8 ** (up.level + 1))::BIGINT
    ),
    steps AS (
        SELECT k, step, coalesce(string_agg(h, '' ORDER BY other) FILTER (WHERE other < me), '') AS l,
            coalesce(string_agg(h, '' ORDER BY other) FILTER (WHERE other > me), '') AS r
        FROM path GROUP BY k, step
    ),
    proofs AS (SELECT k, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY k),
    f AS (
        SELECT k, 0 AS step, coalesce(altered, leaf) AS h FROM d
        UNION ALL
        SELECT k, f.step + 1, sha256(l || h || r) FROM f JOIN steps USING (k, step)
    ),
    ends AS (SELECT k, max_by(h, step) AS folded_root FROM f GROUP BY k)
    SELECT doc_id, leaf, roots.h AS subroot, up.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = up.h AS verified
    FROM d JOIN roots USING (tree) JOIN up ON up.n = 1 LEFT JOIN proofs USING (k) JOIN ends USING (k)
    """,
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of every document, and whether altered texts are found out."""

    def leaf(text: Column) -> Column:
        return merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    altered = F.when(fold(3) == 0, leaf(F.translate("text", UPPER, LOWER)))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("tree"), leaf(F.col("text")).alias("leaf"), altered.alias("carried")
    )
    found = merkle.manifest(rows)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.coalesce("carried", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS_SQL = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}')"


@query(
    "op13_ball_tree_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, unnest({_TERMS_SQL}) AS term FROM documents),
    tf AS (SELECT k, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    len AS (SELECT k, sum(tf)::BIGINT AS n FROM tf GROUP BY k),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs),
    asked AS (SELECT row_number() OVER () AS q, item_id, {_TERMS_SQL} AS terms FROM benchmark),
    bag AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
    scored AS (
        SELECT q, item_id, k, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total.terms))))::BIGINT AS score
        FROM bag JOIN w USING (term) JOIN tf USING (term) JOIN len USING (k), total GROUP BY q, item_id, k, doc_id
    )
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
    """,
)
def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))
