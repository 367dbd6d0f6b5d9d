"""Duplicate detection: exact content groups and near-duplicate file names
(AGG3, AGG4, WIN4, JOI4, DUP1, SET1, SET2, AGG7, JOI5).

Exact groups are hash aggregates (partial aggregation map-side), so a content hash shared
by a third of all rows costs one row per map task; members meet their group through a join
that AQE's skew handling splits.

Near-duplicate names follow the greedy rule: in id order, a file not yet taken, with a
non-empty clean name, leads and takes every later file not yet taken whose name ratio
``2*M/(len_a+len_b)`` (difflib's matching characters M, earlier name first) reaches the
threshold. Only few pairs are compared:

1. Identical clean names are one node (ratio 1.0): every later copy follows the same leader
   as the first copy, so only distinct names are compared.
2. Candidate pairs and their exact ratio come from :mod:`.names`.
3. Leaders are resolved by rounds over the edge list until no node is undecided (no round
   cap): a node follows the earliest leader among its earlier neighbours once every earlier
   neighbour before that leader is known to be a follower; it leads once all its earlier
   neighbours are followers. Each round's state is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..session import shared_dir
from .names import candidate_pairs, name_ratio


# ---- exact duplicates -------------------------------------------------------------------

def content_hash(c) -> "F.Column":
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def exact_groups(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """AGG3: (content_hash, group_size, first_id, last_id) for contents held more than once."""
    return (df.select(id_col, content_hash(content_col).alias("content_hash"))
              .groupBy("content_hash")
              .agg(F.count(F.lit(1)).alias("group_size"), F.min(id_col).alias("first_id"),
                   F.max(id_col).alias("last_id"))
              .where(F.col("group_size") > 1))


def exact_members(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """WIN4: every member of a duplicate group with its keeper (the lowest id)."""
    h = df.select(id_col, content_hash(content_col).alias("content_hash"))
    g = exact_groups(df, id_col, content_col).select("content_hash", F.col("first_id").alias("keeper_id"), "group_size")
    return (h.join(g, "content_hash")
             .select(id_col, "content_hash", "keeper_id", "group_size",
                     (F.col(id_col) == F.col("keeper_id")).alias("is_kept")))


def exact_removed(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Ids the exact pass removes: every member but the keeper."""
    return exact_members(df, id_col, content_col).where(~F.col("is_kept")).select(id_col)


# ---- near-duplicate names -----------------------------------------------------------------

def clean_names(docs: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, clean): non-blank clean names of the files."""
    return docs.select(F.col(id_col).alias("id"), TX.clean_filename(name_col).alias("clean")) \
               .where(~TX.is_blank("clean"))


def distinct_names(docs: DataFrame, id_col: str, name_col: str, cleaned: DataFrame | None = None) -> DataFrame:
    """(clean, rep, n): non-blank clean names, each with its first id and multiplicity."""
    c = cleaned if cleaned is not None else clean_names(docs, id_col, name_col)
    return c.groupBy("clean").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def similar_name_pairs(docs: DataFrame, id_col: str, name_col: str, t: float = K.FUZZY_THRESHOLD,
                       names: DataFrame | None = None) -> DataFrame:
    """JOI4: (a, b, ratio) for distinct clean names (by first id, a < b) with ratio >= t,
    the ratio taken with the earlier name first. Distinct names never reach 1.0, so for
    t >= 1 there is nothing to compare."""
    if names is None:
        shared_dir(docs.sparkSession)
        names = distinct_names(docs, id_col, name_col).checkpoint()
    if t >= 1.0:
        schema = "a long, b long, ratio double"
        return names.sparkSession.createDataFrame([], schema)
    cand = candidate_pairs(names, t)
    return (cand.withColumn("ratio", name_ratio(t)("name_a", "name_b"))
                .where(F.col("ratio").isNotNull()).select("a", "b", "ratio"))


def resolve_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DUP1 core. ``nodes``: rep; ``edges``: (a, b) with a < b. Returns (rep, leader) with
    leader = rep for leaders. Rounds until every node is decided; a node without an earlier
    neighbour leads and takes no part in them."""
    shared_dir(nodes.sparkSession)
    later = edges.select(F.col("b").alias("rep")).distinct()
    first = edges.select(F.col("a").alias("rep")).distinct().join(later, "rep", "left_anti")
    # only nodes with an edge: (rep, leader), leader null while undecided
    state = (first.select("rep", F.col("rep").alias("leader"))
             .unionByName(later.select("rep", F.lit(None).cast("long").alias("leader")))).checkpoint()
    left = state.where("leader is null").count()
    while left:
        e = edges.join(state.where("leader is null").select(F.col("rep").alias("b")), "b")
        e = e.join(state.select(F.col("rep").alias("a"), "leader"), "a")
        leads, open_ = F.col("leader") == F.col("a"), F.col("leader").isNull()
        seen = e.groupBy("b").agg(F.min(F.when(leads, F.col("a"))).alias("lead"), F.min(F.when(open_, F.col("a"))).alias("open"))
        new = seen.select(F.col("b").alias("rep"), F.when(F.col("open").isNull(), F.coalesce("lead", "b"))
                          .when(F.col("open") > F.col("lead"), F.col("lead")).alias("new"))
        state = state.join(new, "rep", "left").select("rep", F.coalesce("leader", "new").alias("leader")).checkpoint()
        before, left = left, state.where("leader is null").count()
        if left == before:  # cannot happen on an acyclic order; guard against a silent loop
            raise RuntimeError("leader resolution made no progress")
    return nodes.select("rep").join(state, "rep", "left").select("rep", F.coalesce("leader", "rep").alias("leader"))


def similar_members(docs: DataFrame, id_col: str, name_col: str, t: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """(id, leader_id, ratio) for every file the name pass removes (followers only); the ratio of
    its cleaned name to its leader's."""
    spark = docs.sparkSession
    shared_dir(spark)
    # cleaned names, distinct names and edges are each read several times (and by every
    # leader round): cut their lineage once by checkpointing to the shared folder
    cleaned = clean_names(docs, id_col, name_col).checkpoint()
    names = distinct_names(docs, id_col, name_col, cleaned).checkpoint()
    edges = similar_name_pairs(docs, id_col, name_col, t, names=names).checkpoint()
    lead = resolve_leaders(names.select("rep"), edges.select("a", "b"))
    to_leader = edges.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "ratio")
    name_leader = names.join(lead, "rep").join(to_leader, ["rep", "leader"], "left").select("clean", "leader", "ratio")
    # the first copy of a leading name leads; every other file follows its name's leader
    return (cleaned.join(name_leader, "clean").where(F.col("id") != F.col("leader"))
                   .select(F.col("id").alias(id_col), F.col("leader").alias("leader_id"),
                           F.coalesce("ratio", F.lit(1.0)).alias("ratio")))


def fuzzy_groups(docs: DataFrame, id_col: str, name_col: str, t: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """DUP1: (id, leader_id) for every file the name pass removes (followers only)."""
    return similar_members(docs, id_col, name_col, t).select(id_col, "leader_id")


def duplicate_report(docs: DataFrame, id_col: str, name_col: str, content_col: str,
                     t: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """Every removal of both passes: (kind, kept_name, removed_name, kept_id, removed_id, ratio)."""
    exact = exact_members(docs, id_col, content_col).where(~F.col("is_kept")).select(
        F.lit("identical").alias("kind"), F.col("keeper_id").alias("kept_id"), F.col(id_col).alias("removed_id"),
        F.lit(1.0).alias("ratio"))
    similar = similar_members(docs, id_col, name_col, t).select(
        F.lit("similar").alias("kind"), F.col("leader_id").alias("kept_id"), F.col(id_col).alias("removed_id"), "ratio")
    name = docs.select(id_col, name_col)
    return (exact.unionByName(similar)
            .join(name.select(F.col(id_col).alias("kept_id"), F.col(name_col).alias("kept_name")), "kept_id")
            .join(name.select(F.col(id_col).alias("removed_id"), F.col(name_col).alias("removed_name")), "removed_id")
            .select("kind", "kept_name", "removed_name", "kept_id", "removed_id", "ratio"))


def removal_sets(exact_ids: DataFrame, similar_ids: DataFrame, id_col: str) -> DataFrame:
    """SET1/SET2/AGG7: removed = exact UNION similar (distinct), skipped = exact INTERSECT
    similar (the second removal attempt finds the file gone)."""
    e = exact_ids.select(id_col).distinct().withColumn("_e", F.lit(1))
    s = similar_ids.select(id_col).distinct().withColumn("_s", F.lit(1))
    both = e.join(s, id_col, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("removed"),
                    F.count(F.when((F.col("_e") == 1) & (F.col("_s") == 1), F.lit(1))).alias("skipped"))


def survivors(docs: DataFrame, removed_ids: DataFrame, id_col: str) -> DataFrame:
    """JOI5: files kept: all minus removed (files are never deleted; this is a table)."""
    return docs.join(removed_ids.select(id_col).distinct(), id_col, "left_anti")
