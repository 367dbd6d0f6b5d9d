"""Duplicate queries (AGG3, AGG4, WIN4, JOI4, DUP1, SET1, SET2, AGG7, JOI5).

Documents play the source files: their text is the file content (exact pass) and their
first sentence + year + '.pdf' the file name (name pass). The name pass runs at the
reference threshold 0.85, where the oracle follows the longest-match recursion in SQL
(:mod:`.namesql`), and, in the queries without ``fuzzy`` in their name, at threshold 1.0, where
"similar" means an identical clean name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import dedup as D
from ..sources import tables as TB
from ._registry import query, round_doubles
from .namesql import FUZZY_SQL
from .text import FILE_NAME_SQL, clean_filename_sql, file_name_col

EXACT_NAME_T = 1.0


def files(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", "text", file_name_col().alias("file_name"))


@query("exact_duplicate_groups", sql="""
    SELECT sha256(text) AS content_hash, count(*)::BIGINT AS group_size, min(doc_id) AS first_id,
           max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf):
    """AGG3: contents (SHA-256) held by more than one file."""
    return D.exact_groups(files(spark, sf), "doc_id", "text")


@query("keep_first_duplicate", sql="""
    WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
    g AS (SELECT content_hash, min(doc_id) AS keeper_id, count(*)::BIGINT AS group_size FROM h GROUP BY 1
          HAVING count(*) > 1)
    SELECT doc_id, content_hash, keeper_id, group_size, doc_id = keeper_id AS is_kept FROM h JOIN g USING (content_hash)""")
def keep_first_duplicate(spark, sf):
    """WIN4: every exact-duplicate member with its keeper (lowest id) and whether it is kept."""
    return D.exact_members(files(spark, sf), "doc_id", "text")


_NAMES_SQL = f"""
    fn AS (SELECT doc_id, text, {FILE_NAME_SQL} AS file_name FROM documents),
    cn AS (SELECT doc_id, text, {clean_filename_sql('file_name')} AS clean FROM fn),
    nm AS (SELECT doc_id, clean, min(doc_id) OVER (PARTITION BY clean) AS leader_id FROM cn
           WHERE regexp_replace(clean, '^\\s+|\\s+$', '', 'g') <> ''),
    sim AS (SELECT doc_id FROM nm WHERE doc_id <> leader_id),
    ex AS (SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS k FROM documents)
           WHERE doc_id <> k)"""


@query("name_duplicate_groups", sql=f"WITH {_NAMES_SQL} SELECT doc_id, leader_id FROM nm WHERE doc_id <> leader_id")
def name_duplicate_groups(spark, sf):
    """DUP1 at threshold 1.0: files whose clean name repeats an earlier file's, with the
    leader they follow."""
    return D.fuzzy_groups(files(spark, sf), "doc_id", "file_name", EXACT_NAME_T)


@query("fuzzy_name_pairs", sql=f"WITH RECURSIVE {FUZZY_SQL} SELECT a, b, round(ratio, 6) AS ratio FROM e")
def fuzzy_name_pairs(spark, sf):
    """JOI4: distinct clean names (by first file id a < b) whose ratio, earlier name first,
    reaches 0.85; candidates from lossless bounds over blocks of names."""
    return round_doubles(D.similar_name_pairs(files(spark, sf), "doc_id", "file_name", K.FUZZY_THRESHOLD))


@query("fuzzy_duplicate_groups", sql=f"WITH RECURSIVE {FUZZY_SQL} SELECT doc_id, leader_id FROM simf")
def fuzzy_duplicate_groups(spark, sf):
    """DUP1: greedy leader clustering of file names at 0.85: (doc_id, leader_id) per
    removed file."""
    return D.fuzzy_groups(files(spark, sf), "doc_id", "file_name", K.FUZZY_THRESHOLD)


def _totals(spark, sf, t):
    f = files(spark, sf)
    ex = D.exact_groups(f, "doc_id", "text").select((F.col("group_size") - 1).alias("e"), F.lit(0).alias("s"))
    sim = D.fuzzy_groups(f, "doc_id", "file_name", t).select(F.lit(0).cast("bigint").alias("e"), F.lit(1).alias("s"))
    both = ex.unionByName(sim).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in
                                     (("e", "exact_extra"), ("s", "similar_followers"))])
    return both.withColumn("total", F.col("exact_extra") + F.col("similar_followers"))


def _totals_sql(sim):
    return f"""SELECT (SELECT count(*) FROM ex)::BIGINT AS exact_extra, (SELECT count(*) FROM {sim})::BIGINT AS similar_followers,
           ((SELECT count(*) FROM ex) + (SELECT count(*) FROM {sim}))::BIGINT AS total"""


@query("duplicate_totals", sql=f"WITH {_NAMES_SQL} {_totals_sql('sim')}")
def duplicate_totals(spark, sf):
    """AGG4: reported total = sum(group size - 1) over exact groups + similar followers
    (a file in both counts twice); names compared at threshold 1.0."""
    return _totals(spark, sf, EXACT_NAME_T)


@query("duplicate_totals_fuzzy", sql=f"WITH RECURSIVE {FUZZY_SQL} {_totals_sql('simf')}")
def duplicate_totals_fuzzy(spark, sf):
    """AGG4 with the name pass at the reference threshold 0.85."""
    return _totals(spark, sf, K.FUZZY_THRESHOLD)


def _removals(spark, sf, t):
    f = files(spark, sf)
    return D.removal_sets(D.exact_removed(f, "doc_id", "text"), D.fuzzy_groups(f, "doc_id", "file_name", t), "doc_id")


def _removals_sql(sim):
    return f"""SELECT (SELECT count(*) FROM (SELECT doc_id FROM ex UNION SELECT doc_id FROM {sim}))::BIGINT AS removed,
           (SELECT count(*) FROM (SELECT doc_id FROM ex INTERSECT SELECT doc_id FROM {sim}))::BIGINT AS skipped"""


@query("removal_summary", sql=f"WITH {_NAMES_SQL} {_removals_sql('sim')}")
def removal_summary(spark, sf):
    """AGG7/SET1/SET2: files removed (exact UNION similar) and removal attempts that found
    the file already gone (exact INTERSECT similar); names at threshold 1.0."""
    return _removals(spark, sf, EXACT_NAME_T)


@query("removal_summary_fuzzy", sql=f"WITH RECURSIVE {FUZZY_SQL} {_removals_sql('simf')}")
def removal_summary_fuzzy(spark, sf):
    """AGG7 with the name pass at the reference threshold 0.85."""
    return _removals(spark, sf, K.FUZZY_THRESHOLD)


def _survivors(spark, sf, t):
    f = files(spark, sf)
    removed = D.exact_removed(f, "doc_id", "text").unionByName(D.fuzzy_groups(f, "doc_id", "file_name", t).select("doc_id"))
    return D.survivors(TB.table(spark, sf, "documents").select("doc_id", "source"), removed, "doc_id")


def _survivors_sql(sim):
    return f"""SELECT doc_id, source FROM documents
           WHERE doc_id NOT IN (SELECT doc_id FROM ex UNION SELECT doc_id FROM {sim})"""


@query("dedup_survivors", sql=f"WITH {_NAMES_SQL} {_survivors_sql('sim')}")
def dedup_survivors(spark, sf):
    """JOI5: the files kept after both passes (anti join against the removal set)."""
    return _survivors(spark, sf, EXACT_NAME_T)


@query("dedup_survivors_fuzzy", sql=f"WITH RECURSIVE {FUZZY_SQL} {_survivors_sql('simf')}")
def dedup_survivors_fuzzy(spark, sf):
    """JOI5 with the name pass at the reference threshold 0.85."""
    return _survivors(spark, sf, K.FUZZY_THRESHOLD)


@query("duplicate_report", sql=f"""WITH RECURSIVE {FUZZY_SQL},
    h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents)
    SELECT 'identical' AS kind, x.file_name AS kept_name, y.file_name AS removed_name, h.kept AS kept_id, h.doc_id AS removed_id,
           1.0::DOUBLE AS ratio
    FROM h JOIN fn x ON x.doc_id = h.kept JOIN fn y ON y.doc_id = h.doc_id WHERE h.doc_id <> h.kept
    UNION ALL
    SELECT 'similar', x.file_name, y.file_name, s.leader_id, s.doc_id, round(coalesce(e.ratio, 1.0), 6)
    FROM simf s JOIN fn x ON x.doc_id = s.leader_id JOIN fn y ON y.doc_id = s.doc_id
    JOIN cn c ON c.doc_id = s.doc_id JOIN nodes n ON n.clean = c.clean
    LEFT JOIN e ON e.a = s.leader_id AND e.b = n.rep""")
def duplicate_report(spark, sf):
    """The duplicates both passes report: kept and removed file with their names and the ratio
    of the cleaned names (1 for identical contents or names)."""
    return round_doubles(D.duplicate_report(files(spark, sf), "doc_id", "file_name", "text", K.FUZZY_THRESHOLD))
