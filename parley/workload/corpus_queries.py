"""Queries on messages, threads and corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.fixed.word_lists import SCAN_PATTERNS, STOPWORDS
from parley.functions import text as tx
from parley.functions.rates import rounded
from parley.operators import profile, threads
from parley.plans import corpus
from parley.workload import seeds
from parley.workload import sql as s
from parley.workload.registry import query

# Text operators ------------------------------------------------------------


@query("clean_message_text", s.with_(["tree"], f"SELECT tweet_id, {s.clean('text')} AS cleaned FROM tree"))
def _(spark, sf):
    return seeds.tree(spark, sf).select("tweet_id", tx.clean_message(F.col("text")).alias("cleaned"))


@query(
    "pii_redact",
    s.with_(
        ["msgs"],
        f"SELECT 'm' || msg_id AS id, md5({s.redact('text')}) AS redacted, md5({s.redact('text', False)}) AS raw_space FROM msgs "
        f"UNION ALL SELECT 'd' || doc_id, md5({s.redact('text')}), md5({s.redact('text', False)}) FROM documents",
    ),
)
def _(spark, sf):
    m = seeds.messages(spark, sf).select(F.concat(F.lit("m"), "msg_id").alias("id"), "text")
    d = seeds.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return m.unionByName(d).select(
        "id",
        F.md5(tx.redact(F.col("text"))).alias("redacted"),
        F.md5(tx.redact(F.col("text"), normalize_space=False)).alias("raw_space"),
    )


def _audit_sql() -> str:
    kinds = [("[EMAIL]", s.EMAIL, "i"), ("[PHONE]", s.PHONE, "c"), ("[ORDER_ID]", s.ORDER, "i"), ("[LINK]", s.URL, "c")]
    parts = [
        f"SELECT {s.q(k)} AS kind, count(*) FILTER (n > 0) AS messages, coalesce(sum(n), 0)::BIGINT AS hits FROM "
        f"(SELECT len(regexp_extract_all(text, {s.q(p)}, 0, '{f}')) AS n FROM documents)"
        for k, p, f in kinds
    ]
    return " UNION ALL ".join(parts)


@query("pii_audit", _audit_sql())
def _(spark, sf):
    return profile.pii_audit(seeds.table(spark, sf, "documents"), "text")


@query(
    "len_filter_pairs",
    s.with_(["pairs"], "SELECT pair_id FROM pairs WHERE length(customer_message) > 3 AND length(brand_reply) > 3"),
)
def _(spark, sf):
    return threads.exportable(seeds.pairs(spark, sf)).select("pair_id")


@query(
    "ascii_ratio_filter",
    f"SELECT doc_id, ({s.ascii_share('text')} > 0.85 AND length({s.strip('text')}) >= 5) AS english_85, "
    f"({s.ascii_share('text')} > 0.90 AND length(text) > 25) AS english_90, {s.ascii_share('text')} > 0.88 AS english_88, "
    f"({s.ascii_share('text')} > 0.85 AND {s.has('text', fx.ENGLISH_WORDS)}) AS english_words FROM documents",
)
def _(spark, sf):
    t = F.col("text")
    return seeds.table(spark, sf, "documents").select(
        "doc_id",
        tx.is_english(t).alias("english_85"),
        ((tx.ascii_share(t) > 0.90) & (F.length(t) > 25)).alias("english_90"),
        (tx.ascii_share(t) > 0.88).alias("english_88"),
        (tx.has(t, fx.ENGLISH_WORDS) & (tx.ascii_share(t) > 0.85)).alias("english_words"),
    )


@query("brand_reply_filter", s.with_(["pairs"], "SELECT pair_id FROM pairs WHERE length(brand_reply) > 10"))
def _(spark, sf):
    return seeds.pairs(spark, sf).where(F.length("brand_reply") > 10).select("pair_id")


@query(
    "parse_created_at",
    s.with_(
        ["msgs"],
        "SELECT msg_id, strftime(try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y')::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS parsed FROM msgs",
    ),
)
def _(spark, sf):
    ts = tx.parse_created_at(F.col("created_at"))
    return seeds.messages(spark, sf).select("msg_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    "reply_signature",
    s.with_(["pairs"], f"SELECT lower(substr({s.strip('brand_reply')}, 1, 60)) AS signature, count(*) AS n FROM pairs GROUP BY 1"),
)
def _(spark, sf):
    sig = tx.reply_signature(F.col("brand_reply")).alias("signature")
    return seeds.pairs(spark, sf).groupBy(sig).agg(F.count("*").alias("n"))


_ENGLISH_OPENING = (
    f"(SELECT * FROM pairs WHERE turn_index = 1 AND {s.ascii_share('customer_message')} > 0.90 AND length(customer_message) > 25)"
)


@query(
    "category_pattern_scan",
    s.with_(
        ["pairs"],
        " UNION ALL ".join(
            f"SELECT {s.q(n)} AS category, count(*) FILTER ({s.has('customer_message', p)}) AS matches FROM {_ENGLISH_OPENING}"
            for n, p in SCAN_PATTERNS
        ),
    ),
)
def _(spark, sf):
    return profile.category_pattern_scan(seeds.pairs(spark, sf))


@query(
    "per_category_examples",
    s.with_(
        [
            "pairs",
            (
                "hit",
                " UNION ALL ".join(
                    f"SELECT {s.q(n)} AS category, pair_id FROM {_ENGLISH_OPENING} WHERE {s.has('customer_message', p)}"
                    for n, p in SCAN_PATTERNS
                ),
            ),
        ],
        "SELECT * FROM (SELECT category, pair_id, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || pair_id), pair_id)::INT AS rank "
        "FROM hit) WHERE rank <= 4",
    ),
)
def _(spark, sf):
    return profile.category_pattern_scan(seeds.pairs(spark, sf), examples=4).select("category", "pair_id", "rank")


@query(
    "thread_views",
    "SELECT conv_id::VARCHAR AS conversation_id, arg_min(text, turn) FILTER (role = 'user') AS initial_customer_query, "
    "count(*) FILTER (role = 'assistant') AS brand_replies FROM conversations WHERE role <> 'system' GROUP BY 1",
)
def _(spark, sf):
    return threads.thread_views(seeds.turns(spark, sf))


# Threads -------------------------------------------------------------------

_TREE = ["tree", s.thread_ctes("tree")]


@query("brand_message_filter", s.with_(_TREE[:1] + [s.thread_ctes("tree")[:3]], "SELECT tweet_id, author_id FROM kept"))
def _(spark, sf):
    return threads.brand_messages(seeds.tree(spark, sf)).select("tweet_id", "author_id")


@query(
    "id_set_union",
    s.with_(["tree", s.thread_ctes("tree")[:2]], "SELECT tweet_id FROM own UNION SELECT tweet_id FROM answered"),
)
def _(spark, sf):
    own = seeds.tree(spark, sf).where(F.col("author_id") == fx.BRAND)
    parents = own.where("in_response_to_tweet_id is not null").select("in_response_to_tweet_id")
    return threads.id_set_union(own.select("tweet_id"), parents)


def _tree_messages(spark, sf):
    return threads.one_row_per_id(threads.brand_messages(seeds.tree(spark, sf)))


@query(
    "reply_parent_join",
    s.with_(_TREE[:1] + [s.thread_ctes("tree")[:4]], "SELECT 'amz_' || customer_id || '_' || reply_id AS pair_id, raw_customer_message, raw_brand_reply FROM replies"),
)
def _(spark, sf):
    return threads.reply_parents(_tree_messages(spark, sf)).select("pair_id", "raw_customer_message", "raw_brand_reply")


_ALL_STARTS = [
    (n, b.replace("WHERE tweet_id IN (SELECT customer_id FROM replies) ", "") if n == "walk" else b)
    for n, b in s.thread_ctes("tree")
]


@query(
    "thread_ancestry",
    s.with_(["tree", _ALL_STARTS], "SELECT start AS tweet_id, root_id, prior_customers::INT AS prior_customers, prior_context FROM history"),
)
def _(spark, sf):
    return threads.lineage(_tree_messages(spark, sf)).select(
        "tweet_id", "root_id", F.col("prior_customers").cast("int").alias("prior_customers"), "prior_context"
    )


def _tree_pairs(spark, sf):
    return threads.dialogue_pairs(_tree_messages(spark, sf))


def _chat_pairs(spark, sf):
    return corpus.build_pairs(seeds.chat(spark, sf))


@query("conversation_root", s.with_(_TREE, f"SELECT conversation_id, count(*) AS pairs FROM ({s.TREE_PAIRS}) GROUP BY 1"))
def _(spark, sf):
    return _tree_pairs(spark, sf).groupBy("conversation_id").agg(F.count("*").alias("pairs"))


@query("thread_context", s.with_(_TREE, f"SELECT pair_id, thread_context FROM ({s.TREE_PAIRS})"))
def _(spark, sf):
    return _tree_pairs(spark, sf).select("pair_id", "thread_context")


@query("turn_index", s.with_(["chat", s.thread_ctes("chat")], f"SELECT turn_index, count(*) AS pairs FROM ({s.TREE_PAIRS}) GROUP BY 1"))
def _(spark, sf):
    pairs = threads.dialogue_pairs(threads.one_row_per_id(threads.brand_messages(seeds.chat(spark, sf))))
    return pairs.groupBy("turn_index").agg(F.count("*").alias("pairs"))


_EXPORT = "length(customer_message) > 3 AND length(brand_reply) > 3"


@query("build_pairs", s.with_(_TREE, f"SELECT * FROM ({s.TREE_PAIRS}) WHERE {_EXPORT}"))
def _(spark, sf):
    return corpus.build_pairs(seeds.tree(spark, sf))


@query(
    "build_pairs_linear",
    s.with_(["chat", s.thread_ctes("chat")], f"SELECT * FROM ({s.TREE_PAIRS}) WHERE {_EXPORT}"),
)
def _(spark, sf):
    return _chat_pairs(spark, sf)


@query(
    "sort_pairs",
    s.with_(["pairs"], "SELECT pair_id, row_number() OVER (ORDER BY conversation_id, turn_index, brand_tweet_id) AS position FROM pairs"),
)
def _(spark, sf):
    # Positions are read off the sorted output: partitions ascend, and ids ascend within each.
    from parley.operators.topn import number_rows
    from parley.session import stage

    ordered = threads.sort_pairs(seeds.pairs(spark, sf)).withColumn("at", F.monotonically_increasing_id())
    placed = number_rows(stage(ordered.select("pair_id", "at"), "sorted"), ["at"])
    return placed.select("pair_id", F.col("position").cast("long").alias("position"))


@query("head_pairs", s.with_(["pairs"], "SELECT pair_id FROM pairs ORDER BY conversation_id, turn_index, brand_tweet_id LIMIT 50"))
def _(spark, sf):
    return threads.head_pairs(seeds.pairs(spark, sf), 50).select("pair_id")


# Profiles ------------------------------------------------------------------


def _stats(unit: str, expr: str, source: str = "documents", column: str = "text") -> str:
    quant = lambda p: f"round(quantile_cont(n, {p}), 4)"
    return (
        f"SELECT '{unit}' AS unit, count(*) AS texts, round(avg(n), 4) AS mean, {quant(0.5)} AS median, round(stddev_samp(n), 4) AS std, "
        f"min(n)::INT AS min, {quant(0.25)} AS p25, {quant(0.75)} AS p75, {quant(0.95)} AS p95, max(n)::INT AS max "
        f"FROM (SELECT {expr} AS n FROM {source} WHERE {column} IS NOT NULL)"
    )


@query("length_stats", _stats("char", "length(text)") + " UNION ALL " + _stats("word", s.word_count("text")))
def _(spark, sf):
    df = profile.length_stats(seeds.table(spark, sf, "documents"), "text")
    return df.select(
        "unit", "texts", *[rounded(c, 4).alias(c) if c not in ("min", "max") else F.col(c).cast("int") for c in df.columns[2:]]
    )


_PARSED = "try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y')::TIMESTAMP"


@query(
    "monthly_volume",
    s.with_(["msgs"], f"SELECT strftime({_PARSED}, '%Y-%m') AS month, count(*) AS messages FROM msgs WHERE {_PARSED} IS NOT NULL GROUP BY 1"),
)
def _(spark, sf):
    return profile.monthly_volume(seeds.messages(spark, sf), "created_at")


@query(
    "date_range",
    s.with_(["msgs"], f"SELECT strftime(min({_PARSED}), '%Y-%m-%d') AS min_date, strftime(max({_PARSED}), '%Y-%m-%d') AS max_date FROM msgs"),
)
def _(spark, sf):
    return profile.date_range(seeds.messages(spark, sf), "created_at")


@query(
    "turn_distribution",
    s.with_(["chat", s.thread_ctes("chat")], f"SELECT turn_index, count(*) AS pairs FROM ({s.TREE_PAIRS}) WHERE {_EXPORT} GROUP BY 1 ORDER BY 1 LIMIT 5"),
)
def _(spark, sf):
    return profile.turn_distribution(_chat_pairs(spark, sf))


_SUMMARY = (
    "SELECT count(*) AS total_pairs, count(DISTINCT conversation_id) AS conversations, count(*) FILTER (turn_index = 1) AS opening_pairs, "
    "count(*) FILTER (turn_index <> 1) AS followup_pairs, round(count(*) FILTER (turn_index = 1) * 100.0::DOUBLE / count(*), 2) AS opening_pct, "
    "round(count(*) FILTER (turn_index <> 1) * 100.0::DOUBLE / count(*), 2) AS followup_pct FROM "
)


@query("corpus_summary", s.with_(["pairs"], _SUMMARY + "pairs"))
def _(spark, sf):
    return profile.corpus_summary(seeds.pairs(spark, sf))


def ngram_sql(source: str, column: str, n: int, k: int, opening: bool = False, stop: bool = False) -> str:
    words = f"list_filter(regexp_extract_all(lower({column}), '{s.WORD}+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))"
    if opening:
        words = f"({words})[1:6]"
    if stop:
        words = f"list_filter({words}, lambda w: NOT list_contains({s.listing(STOPWORDS)}, w))"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return (
        f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)::BIGINT), lambda i: {gram})) AS gram "
        f"FROM (SELECT {words} AS w FROM {source} WHERE {column} IS NOT NULL)) GROUP BY gram ORDER BY n DESC, gram LIMIT {k}"
    )


@query("ngram_topk", ngram_sql("documents", "text", 2, 50))
def _(spark, sf):
    return profile.ngram_topk(seeds.table(spark, sf, "documents"), "text", 2, 50)


@query("ngram_topk_two_rounds", ngram_sql("documents", "text", 2, 50))
def _(spark, sf):
    # As for a table of many partitions.
    return profile.ngram_topk(seeds.table(spark, sf, "documents"), "text", 2, 50, two_rounds=True)


_OPENINGS = "(SELECT * FROM pairs WHERE turn_index = 1)"
for _name, _fn, _sql in [
    ("opening_bigrams", profile.opening_bigrams, ngram_sql(_OPENINGS, "customer_message", 2, 15, opening=True)),
    ("opening_trigrams", profile.opening_trigrams, ngram_sql(_OPENINGS, "customer_message", 3, 15, opening=True)),
    ("content_keywords", profile.content_keywords, ngram_sql("pairs", "customer_message", 1, 20, stop=True)),
    ("content_bigrams", profile.content_bigrams, ngram_sql("pairs", "customer_message", 2, 15, stop=True)),
]:
    query(_name, s.with_(["pairs"], _sql))(lambda spark, sf, fn=_fn: fn(seeds.pairs(spark, sf)))


def _boiler(column: str, source: str = "pairs") -> str:
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS total, count(DISTINCT {column}) AS distinct_values, "
        f"round(count(DISTINCT {column}) / count(*)::DOUBLE, 6) AS uniqueness_ratio, "
        f"round((SELECT sum(n) FROM (SELECT count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY n DESC LIMIT 10)) * 100.0::DOUBLE / count(*), 4) "
        f"AS top_10_share_pct FROM {source}"
    )


@query(
    "boilerplate_report",
    s.with_(["pairs"], _boiler("brand_reply") + " UNION ALL " + _boiler("customer_message") + " UNION ALL " + _boiler("text", "documents")),
)
def _(spark, sf):
    pairs = seeds.pairs(spark, sf)
    return (
        profile.boilerplate_report(pairs, "brand_reply")
        .unionByName(profile.boilerplate_report(pairs, "customer_message"))
        .unionByName(profile.boilerplate_report(seeds.table(spark, sf, "documents"), "text"))
    )


@query(
    "boilerplate_values",
    "SELECT md5(text) AS value, count(*) AS n FROM documents GROUP BY text ORDER BY n DESC, text LIMIT 15",
)
def _(spark, sf):
    return profile.boilerplate_values(seeds.table(spark, sf, "documents"), "text").select(F.md5("value").alias("value"), "n")


def _sample_sql(openings: int, followups: int, where: str = "TRUE") -> str:
    part = lambda cond, n: f"(SELECT pair_id FROM pairs WHERE {cond} AND {where} ORDER BY md5('42:' || pair_id), pair_id LIMIT {n})"
    return f"SELECT * FROM {part('turn_index = 1', openings)} UNION ALL SELECT * FROM {part('turn_index > 1', followups)}"


@query("stratified_sample", s.with_(["pairs"], _sample_sql(30, 10)))
def _(spark, sf):
    return profile.sample_pairs(seeds.pairs(spark, sf), 40).select("pair_id")


@query(
    "sample_union",
    s.with_(
        ["pairs"],
        _sample_sql(30, 10, f"{s.has('customer_message', fx.ENGLISH_WORDS)} AND {s.ascii_share('customer_message')} > 0.85"),
    ),
)
def _(spark, sf):
    return profile.stratified_sample(profile.english_pairs(seeds.pairs(spark, sf)), 30, 10).select("pair_id")


_TREE_COLS = ["tweet_id", "author_id", "inbound", "created_at", "text", "in_response_to_tweet_id"]


@query(
    "inspect_source",
    s.with_(
        ["tree"],
        "SELECT 'rows' AS part, NULL AS name, count(*) AS value FROM tree UNION ALL SELECT * FROM (VALUES "
        + ", ".join(f"('column', '{c}', {k})" for k, c in enumerate(_TREE_COLS))
        + ") UNION ALL SELECT * FROM (SELECT 'author', author_id, count(*) FROM tree GROUP BY author_id ORDER BY 3 DESC, 2 LIMIT 10)",
    ),
)
def _(spark, sf):
    return profile.inspect_source(seeds.tree(spark, sf).select(*_TREE_COLS))


@query(
    "category_distribution",
    s.with_(
        ["gold"],
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, {c}::VARCHAR AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM gold), 1) AS share_pct FROM gold GROUP BY 2"
            for c in ("true_intent", "difficulty", "true_escalate")
        ),
    ),
)
def _(spark, sf):
    gold = seeds.gold(spark, sf)
    parts = [
        profile.share_by(gold, c).select(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), "n", "share_pct")
        for c in ("true_intent", "difficulty", "true_escalate")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LENGTHS = ["texts", "mean", "median", "std", "min", "p25", "p75", "p95", "max"]
_SHARES = ["total", "distinct_values", "uniqueness_ratio", "top_10_share_pct"]


def _explore_sql() -> str:
    cols = ["total_pairs", "conversations", "opening_pairs", "followup_pairs", "opening_pct", "followup_pct"]
    parts = [f"SELECT 'summary' AS section, '{c}' AS key, {c}::DOUBLE AS value FROM ({_SUMMARY} pairs)" for c in cols]
    parts.append("SELECT 'turns', turn_index::VARCHAR, count(*)::DOUBLE FROM pairs GROUP BY 2")
    parsed = _PARSED.replace("created_at", "customer_created_at")
    parts.append(f"SELECT 'monthly_volume', strftime({parsed}, '%Y-%m'), count(*)::DOUBLE FROM pairs WHERE {parsed} IS NOT NULL GROUP BY 2")
    for name, sql in [
        ("opening_bigrams", ngram_sql(_OPENINGS, "customer_message", 2, 15, opening=True)),
        ("opening_trigrams", ngram_sql(_OPENINGS, "customer_message", 3, 15, opening=True)),
        ("content_keywords", ngram_sql("pairs", "customer_message", 1, 20, stop=True)),
        ("content_bigrams", ngram_sql("pairs", "customer_message", 2, 15, stop=True)),
    ]:
        parts.append(f"SELECT '{name}', gram, n::DOUBLE FROM ({sql})")
    for name, col in [("top_replies", "brand_reply"), ("top_messages", "customer_message")]:
        parts.append(f"SELECT '{name}', v, n::DOUBLE FROM (SELECT {col} AS v, count(*) AS n FROM pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)")
    for name, col in [("customer_lengths", "customer_message"), ("reply_lengths", "brand_reply")]:
        for unit, expr in (("char", f"length({col})"), ("word", s.word_count(col))):
            stats = _stats(unit, expr, "pairs", col)
            parts += [f"SELECT '{name}', '{unit} {c}', round({c}, 4)::DOUBLE FROM ({stats})" for c in _LENGTHS]
    for name, col in [("reply_boilerplate", "brand_reply"), ("customer_boilerplate", "customer_message")]:
        parts += [f"SELECT '{name}', '{c}', {c}::DOUBLE FROM ({_boiler(col)})" for c in _SHARES]
    parts += [f"SELECT 'date_range', strftime({fn}({parsed}), '%Y-%m-%d'), 1::DOUBLE FROM pairs" for fn in ("min", "max")]
    parts.append(f"SELECT 'sample', pair_id, 1::DOUBLE FROM ({_sample_sql(30, 10)})")
    return s.with_(["pairs"], " UNION ALL ".join(parts))


@query("explore", _explore_sql())
def _(spark, sf):
    out = corpus.explore(seeds.pairs(spark, sf))
    summary = out["summary"]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in summary.columns])
    rows = summary.select(F.explode(entries).alias("e")).select(F.lit("summary").alias("section"), "e.key", "e.value")
    for name in ("turns", "monthly_volume", "opening_bigrams", "opening_trigrams", "content_keywords", "content_bigrams", "top_replies", "top_messages"):
        key, value = out[name].columns
        rows = rows.unionByName(
            out[name].select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
        )

    def wide(name, df, columns, lead=""):
        value = lambda c: rounded(F.col(c).cast("double"), 4) if name.endswith("lengths") else F.col(c).cast("double")
        key = lambda c: F.concat(F.col(lead), F.lit(f" {c}")) if lead else F.lit(c)
        cells = F.array(*[F.struct(key(c).alias("key"), value(c).alias("value")) for c in columns])
        return df.select(F.lit(name).alias("section"), F.explode(cells).alias("e")).select("section", "e.key", "e.value")

    def names(name, df, column):
        return df.select(F.lit(name).alias("section"), F.col(column).cast("string").alias("key"), F.lit(1.0).alias("value"))

    for name in ("customer_lengths", "reply_lengths"):
        rows = rows.unionByName(wide(name, out[name], _LENGTHS, "unit"))
    for name in ("reply_boilerplate", "customer_boilerplate"):
        rows = rows.unionByName(wide(name, out[name], _SHARES))
    for column in ("min_date", "max_date"):
        rows = rows.unionByName(names("date_range", out["date_range"], column))
    return rows.unionByName(names("sample", out["sample"], "pair_id"))
