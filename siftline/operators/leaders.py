"""Learned patterns: leader clustering in arrival order, exactly and in parallel.

Sequential meaning: a snippet joins the first known pattern it is similar to, else it
becomes a pattern itself.  Two snippets are similar when their structure is equal or their
token overlap is above 0.7.  A pattern never changes, so equal snippets always share one
fate and only distinct snippets matter.  A distinct snippet is a leader exactly when no
earlier leader is similar to it.

Similar snippets always share a key: the structure, or one of the rarest tokens (the
prefix filter of set-similarity joins).  Rounds over those keys settle the leaders; no
step collects a type, a key or a group into one task.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as T
from ..session import cut_lineage
from . import learning

TYPE = "vulnerability_type"
MIN_ROUNDS = 2


def _keys(nodes: DataFrame) -> DataFrame:
    """(id, type, key): the structure and the rare-token prefix of every snippet."""
    tokens = nodes.select("id", TYPE, F.explode("tokens").alias("token"))
    frequency = tokens.groupBy(TYPE, "token").agg(F.count("*").alias("n"))
    ranked = tokens.join(frequency, [TYPE, "token"]).groupBy("id", TYPE).agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by_rarity"))
    # overlap above 7/10 of the set must touch this many of its rarest tokens
    length = F.size("by_rarity") - F.floor(F.size("by_rarity") * 7 / 10).cast("int")
    rare = ranked.select("id", TYPE, F.explode(F.slice("by_rarity", F.lit(1), length)).alias("t")).select(
        "id", TYPE, F.concat(F.lit("t:"), F.col("t.token")).alias("key"))
    return rare.unionByName(nodes.select("id", TYPE, F.concat(F.lit("h:"), "structure_hash").alias("key")))


def _is_similar() -> Column:
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    together = F.size(F.array_union("a_tokens", "b_tokens"))
    overlap = (F.size("a_tokens") > 0) & (F.size("b_tokens") > 0) & (shared / together > 0.7)
    return (F.col("a_hash") == F.col("b_hash")) | overlap


def _similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) pairs whose snippets are similar."""
    described = nodes.select("id", F.col("tokens"), F.col("structure_hash").alias("hash"))

    def side(name):
        return described.select(*[F.col(c).alias(f"{name}_{c}" if c != "id" else name) for c in described.columns])

    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(_is_similar()).select("a", "b")


def _shared_key_pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
    left = earlier.select(TYPE, "key", F.col("id").alias("a"))
    right = later.select(TYPE, "key", F.col("id").alias("b"))
    return left.join(right, [TYPE, "key"]).filter(F.col("a") < F.col("b")).select("a", "b")


def _settle_by_first(nodes, keys, open_nodes):
    """One round: who is first under all its keys leads; those similar to it are settled."""
    open_keys = keys.join(open_nodes, "id", "left_semi")
    first = open_keys.groupBy(TYPE, "key").agg(F.min("id").alias("first"))
    marked = open_keys.join(first, [TYPE, "key"])
    leads = marked.groupBy("id").agg(F.bool_and(F.col("first") == F.col("id")).alias("ok")).filter("ok").select("id")
    leads = cut_lineage(leads)
    followers = _similar(_shared_key_pairs(open_keys.join(leads, "id", "left_semi"), open_keys), nodes)
    left = open_nodes.join(leads, "id", "left_anti").join(
        followers.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
    return leads, cut_lineage(left)


def _settle_by_edges(edges, open_nodes):
    """One round on explicit similar pairs: who has no open earlier partner leads."""
    live = edges.join(open_nodes.withColumnRenamed("id", "a"), "a", "left_semi").join(
        open_nodes.withColumnRenamed("id", "b"), "b", "left_semi")
    leads = cut_lineage(open_nodes.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
    followers = live.join(leads.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    left = open_nodes.join(leads, "id", "left_anti").join(followers, "id", "left_anti")
    return leads, cut_lineage(left)


def learn_patterns(feedback: DataFrame) -> DataFrame:
    """Patterns learned from confirmed findings: one row per leader with its confirmations."""
    snippets = learning.distinct_snippets(feedback.filter("was_correct"))
    nodes = cut_lineage(snippets.withColumn("id", F.col("first_seq")))
    keys = cut_lineage(_keys(nodes))
    open_nodes = nodes.select("id")
    settled = []
    # first the dense part: a snippet with many near copies settles them in one round
    for _ in range(MIN_ROUNDS):
        leads, open_nodes = _settle_by_first(nodes, keys, open_nodes)
        settled.append(leads)
    if not open_nodes.isEmpty():
        open_keys = keys.join(open_nodes, "id", "left_semi")
        edges = cut_lineage(_similar(_shared_key_pairs(open_keys, open_keys), nodes))
        while not open_nodes.isEmpty():
            leads, open_nodes = _settle_by_edges(edges, open_nodes)
            settled.append(leads)
    leaders = settled[0]
    for leads in settled[1:]:
        leaders = leaders.unionByName(leads)
    leaders = cut_lineage(leaders)
    # every other snippet joins its earliest similar leader
    joins = _similar(_shared_key_pairs(keys.join(leaders, "id", "left_semi"), keys), nodes)
    member = joins.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    member = member.join(leaders, "id", "left_anti").unionByName(leaders.withColumn("leader", F.col("id")))
    sizes = nodes.join(member, "id").groupBy("leader").agg(
        F.sum("arrivals").alias("confirmations"), F.max("last_seq").alias("last_seen"))
    found = nodes.select(TYPE, "structure_hash", "code_example", F.col("id").alias("leader"), F.col("first_seq").alias("first_seen"))
    return found.join(sizes, "leader").select(
        TYPE, "structure_hash", "code_example", F.lit(0.1).alias("confidence_boost"), "confirmations", "first_seen", "last_seen")


def learned_and_avoided(feedback: DataFrame) -> DataFrame:
    """Leader patterns of confirmed findings, and every distinct false positive as a pattern that lowers confidence.

    False positives are never merged by similarity: each record counts in the row of its snippet, under its own type name.
    """
    wrong = feedback.filter(~F.col("was_correct")).groupBy(TYPE, "code_snippet").agg(
        F.count("*").alias("confirmations"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"))
    avoided = wrong.select(
        F.concat(F.lit(fixed.FALSE_POSITIVE_PREFIX), TYPE).alias(TYPE), T.structure_hash("code_snippet").alias("structure_hash"),
        F.col("code_snippet").alias("code_example"), F.lit(-0.2).alias("confidence_boost"), "confirmations", "first_seen", "last_seen")
    return learn_patterns(feedback).unionByName(avoided)
