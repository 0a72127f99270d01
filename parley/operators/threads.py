"""Reply threads: which messages belong to a brand, and customer/brand pairs with their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.fixed import wording as fx
from parley.functions import text as tx
from parley.operators.topn import EARLY_LIMIT, number_rows
from parley.session import drop_staged, stage, stage_counted


def one_row_per_id(messages: DataFrame) -> DataFrame:
    """Keep one row per tweet id; among copies the greatest row, so the choice is repeatable."""
    rest = [c for c in messages.columns if c != "tweet_id"]
    return (
        messages.groupBy("tweet_id").agg(F.max(F.struct(*rest)).alias("row")).select("tweet_id", "row.*")
    )


def id_set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def brand_messages(messages: DataFrame, brand: str = fx.BRAND) -> DataFrame:
    """Brand messages, the messages they answer, and the messages that answer them.

    The messages are read twice: ids of the brand's own ones first, then whole rows, flagged by both id sets.
    """
    # Staged, so that the joins below shuffle both sides and a tweet with very many answers can be split.
    own = stage(
        messages.where(F.col("author_id") == brand).select("tweet_id", "in_response_to_tweet_id"), "brand-ids"
    )
    own_ids = own.select("tweet_id").distinct()
    answered = own.where("in_response_to_tweet_id is not null").select(
        F.col("in_response_to_tweet_id").alias("tweet_id")
    )
    relevant = stage(id_set_union(own_ids, answered).select("tweet_id", F.lit(True).alias("_inside")), "brand-relevant")
    parents = stage(own_ids.select(F.col("tweet_id").alias("in_response_to_tweet_id"), F.lit(True).alias("_follows")), "brand-parents")
    flagged = messages.join(relevant, "tweet_id", "left").join(parents, "in_response_to_tweet_id", "left")
    return flagged.where(F.col("_inside") | F.col("_follows")).select(*messages.columns)


def _replies(messages: DataFrame, brand: str) -> DataFrame:
    return messages.where((F.col("author_id") == brand) & F.col("in_response_to_tweet_id").isNotNull()).select(
        F.col("tweet_id").alias("reply_id"),
        F.col("in_response_to_tweet_id").alias("customer_id"),
        F.col("text").alias("raw_brand_reply"),
        F.col("created_at").alias("brand_created_at"),
    )


def _customers(messages: DataFrame) -> DataFrame:
    return messages.where("inbound").select(
        F.col("tweet_id").alias("customer_id"),
        F.col("text").alias("raw_customer_message"),
        F.col("created_at").alias("customer_created_at"),
    )


def _pair_id() -> Column:
    return F.format_string(fx.PAIR_PREFIX + "%d_%d", "customer_id", "reply_id")


def reply_parents(messages: DataFrame, brand: str = fx.BRAND) -> DataFrame:
    """Each brand reply beside the customer message it answers."""
    pairs = _replies(messages, brand).join(_customers(messages), "customer_id")
    return pairs.withColumn("pair_id", _pair_id())


def _turns(messages: DataFrame, brand: str) -> DataFrame:
    """One node per message: its parent if that is present, speaker flag and printed line."""
    speaker = F.when(F.col("inbound"), F.lit(fx.CUSTOMER)).otherwise(F.lit(brand))
    nodes = messages.select(
        "tweet_id",
        F.col("in_response_to_tweet_id").alias("parent_id"),
        F.col("inbound").cast("int").alias("customers"),
        F.concat(F.lit("["), speaker, F.lit("]: "), tx.clean_message(F.col("text"))).alias("line"),
    )
    present = messages.select(F.col("tweet_id").alias("parent_id"), F.lit(True).alias("_present"))
    # Rows without a parent stay out of the join, where they would share one key.
    child = nodes.where("parent_id is not null").join(present, "parent_id", "left")
    child = child.withColumn("parent_id", F.when(F.col("_present"), F.col("parent_id")))
    return nodes.where("parent_id is null").unionByName(child.select(*nodes.columns))


def _double(state: DataFrame) -> DataFrame:
    """Join each open chain with the chain of its jump target, doubling its reach."""
    target = state.select(
        F.col("tweet_id").alias("jump_id"),
        F.col("jump_id").alias("next_jump"),
        F.col("history").alias("older"),
        F.col("customers").alias("older_customers"),
        F.col("root_id").alias("older_root"),
    )
    grown = (
        state.where("jump_id is not null")
        .drop("root_id")
        .join(target, "jump_id")
        .select(
            "tweet_id",
            F.col("next_jump").alias("jump_id"),
            F.concat("older", F.lit(fx.TURN_SEPARATOR), "history").alias("history"),
            (F.col("customers") + F.col("older_customers")).alias("customers"),
            F.col("older_root").alias("root_id"),
        )
    )
    return state.where("jump_id is null").unionByName(grown)


def _on_cycles(turns: DataFrame) -> DataFrame | None:
    """Turns on reply cycles with cycle_id and steps to the cycle's smallest id; None where there is no cycle.

    Works on ids alone. Chains are doubled until none ends any more and the set of turns they reach stops shrinking:
    then that set is the cycles.
    """
    reached = lambda df: df.select("hop").distinct().count()
    hops, left = stage_counted(
        turns.where("parent_id is not null").select("tweet_id", F.col("parent_id").alias("hop")), "hops", F.count("*")
    )
    size = None
    while left:
        target = hops.select(F.col("tweet_id").alias("hop"), F.col("hop").alias("next"))
        further, n = stage_counted(hops.join(target, "hop").select("tweet_id", F.col("next").alias("hop")), "hops", F.count("*"))
        drop_staged(hops)
        hops = further
        if n == left:  # nothing ended in this round
            now = reached(hops)
            if now == size:
                break
            size = now
        left = n
    if not left:
        return None
    ids = hops.select(F.col("hop").alias("tweet_id")).distinct()
    ring = stage(turns.join(ids, "tweet_id", "left_semi").select("tweet_id", "parent_id", "customers", "line"), "rings")
    # Smallest id within reach, and the steps to it, by doubling.
    state = ring.select("tweet_id", F.col("parent_id").alias("hop"), F.struct(F.col("tweet_id").alias("id"), F.lit(0).cast("long").alias("steps")).alias("least"))
    reach = 1
    while reach < 2 * ring.count():
        target = state.select(F.col("tweet_id").alias("hop"), F.col("hop").alias("next"), F.struct("least.id", (F.col("least.steps") + reach).alias("steps")).alias("far"))
        state = stage(
            state.join(target, "hop").select("tweet_id", F.col("next").alias("hop"), F.least("least", "far").alias("least")), "ring-steps"
        )
        reach *= 2
    return ring.join(
        state.select("tweet_id", F.col("least.id").alias("cycle_id"), F.col("least.steps").alias("pos")), "tweet_id"
    )


def _rotations(ring: DataFrame) -> DataFrame:
    """Per turn on a cycle: root, history before it and with it, and the customer turns of each.

    A turn's chain runs once around its cycle. The turns of a cycle are put into one array, which is as long as each of
    the histories made from it.
    """
    whole = ring.groupBy("cycle_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "tweet_id", "line"))).alias("turns"), F.sum("customers").alias("all_customers")
    )
    n, k = F.size("turns"), F.col("pos").cast("int")
    # From the oldest: the turn one step beyond this one, around the cycle, to this one.
    older = F.concat(F.slice("turns", k + 2, F.greatest(n - k - 1, F.lit(0))), F.slice("turns", F.lit(1), k))
    text = lambda turns: F.array_join(F.transform(turns, lambda t: t["line"]), fx.TURN_SEPARATOR)
    return (
        ring.join(whole, "cycle_id")
        .withColumn("older", older)
        .select(
            "tweet_id",
            F.coalesce(F.try_element_at("older", F.lit(1))["tweet_id"], F.col("tweet_id")).alias("root_id"),
            (F.col("all_customers") - F.col("customers")).cast("int").alias("prior_customers"),
            F.when(F.size("older") > 0, text(F.col("older"))).alias("prior_context"),
            F.col("all_customers").cast("int").alias("customers"),
            F.concat_ws(fx.TURN_SEPARATOR, F.when(F.size("older") > 0, text(F.col("older"))), "line").alias("history"),
        )
    )


def lineage(messages: DataFrame, brand: str = fx.BRAND) -> DataFrame:
    """Root, history text and number of customer turns before each message.

    Histories are assembled by doubling: after round k a chain spans 2^k turns, so a thread of n turns takes
    log2(n) joins with one row per message, and no thread is ever gathered into one group.
    Only chains still open are joined. Cycles are found on ids first; a turn on a cycle then starts with one run around
    it as its history, so chains that lead into cycles end like any other.
    """
    open_count = lambda column: F.count_if(F.col(column).isNotNull())
    turns, open_now = stage_counted(_turns(messages, brand), "turns", open_count("parent_id"))
    state = turns.select(
        "tweet_id",
        F.col("parent_id").alias("jump_id"),
        F.col("line").alias("history"),
        "customers",
        F.when(F.col("parent_id").isNull(), F.col("tweet_id")).alias("root_id"),
    )
    ring = _on_cycles(turns)
    if ring is not None:
        ring = stage(_rotations(ring), "rotations")
        closed = ring.select("tweet_id", F.lit(None).cast("long").alias("jump_id"), "history", "customers", "root_id")
        state = state.join(ring.select("tweet_id"), "tweet_id", "left_anti").unionByName(closed)
        state, open_now = stage_counted(state, "chains", open_count("jump_id"))
    staged = None
    while open_now:
        older = staged
        staged, open_now = stage_counted(_double(state), "chains", open_count("jump_id"))
        if older is not None:
            drop_staged(older)
        state = staged

    parent = state.select(
        F.col("tweet_id").alias("parent_id"),
        F.col("root_id"),
        F.col("customers").alias("prior_customers"),
        F.col("history").alias("prior_context"),
    )
    first = turns.where("parent_id is null").select(
        "tweet_id",
        F.col("tweet_id").alias("root_id"),
        F.lit(0).alias("prior_customers"),
        F.lit(None).cast("string").alias("prior_context"),
    )
    child = turns.where("parent_id is not null").select("tweet_id", "parent_id")
    if ring is not None:
        child = child.join(ring.select("tweet_id"), "tweet_id", "left_anti")
    later = child.join(parent, "parent_id").select("tweet_id", "root_id", "prior_customers", "prior_context")
    out = first.unionByName(later)
    return out if ring is None else out.unionByName(ring.select(*out.columns))


def dialogue_pairs(messages: DataFrame, brand: str = fx.BRAND) -> DataFrame:
    """Customer/brand pairs with thread root, turn index and preceding context.

    Expects the brand's messages with one row per id.
    """
    reply, customer = _replies(messages, brand), _customers(messages)
    history = lineage(messages, brand).withColumnRenamed("tweet_id", "customer_id")
    # One row per customer message. Staged, so that the last join shuffles both sides directly: only then can adaptive
    # execution split the replies of a message that has very many.
    asked = stage(customer.join(history, "customer_id"), "asked")
    return reply.join(asked, "customer_id").select(
        _pair_id().alias("pair_id"),
        F.col("root_id").cast("string").alias("conversation_id"),
        (F.col("prior_customers") + 1).cast("int").alias("turn_index"),
        F.col("customer_id").cast("string").alias("customer_tweet_id"),
        F.col("reply_id").cast("string").alias("brand_tweet_id"),
        tx.clean_message(F.col("raw_customer_message")).alias("customer_message"),
        "raw_customer_message",
        tx.clean_message(F.col("raw_brand_reply")).alias("brand_reply"),
        "raw_brand_reply",
        F.coalesce("prior_context", F.lit(fx.NO_CONTEXT)).alias("thread_context"),
        "customer_created_at",
        "brand_created_at",
    )


PAIR_ORDER = ["conversation_id", "turn_index", "brand_tweet_id"]


def sort_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(*PAIR_ORDER)


def head_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """First n pairs in export order; a large n is taken by position, so that no task merges n rows of every partition."""
    if n <= EARLY_LIMIT:
        return sort_pairs(pairs).limit(n)
    return number_rows(pairs, PAIR_ORDER).where(F.col("position") <= n).drop("position").orderBy(*PAIR_ORDER)


def exportable(pairs: DataFrame) -> DataFrame:
    """Pairs whose two messages have more than three characters."""
    return pairs.where((F.length("customer_message") > 3) & (F.length("brand_reply") > 3))


def thread_views(turns: DataFrame) -> DataFrame:
    """Per conversation the opening customer text and the number of brand turns.

    Computed by aggregates, not by gathering a conversation into an array.
    """
    brand = F.col("is_brand_reply")
    return turns.groupBy("conversation_id").agg(
        F.min_by(F.when(~brand, F.col("text")), F.when(~brand, F.col("pos"))).alias("initial_customer_query"),
        F.count_if(brand).alias("brand_replies"),
    )


def brand_replies(turns: DataFrame) -> DataFrame:
    return turns.where("is_brand_reply")
