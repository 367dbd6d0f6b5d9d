"""Duplicate cleaning as tables: what the exact and name passes remove, the summary, and
the files kept. Nothing is deleted; the caller acts on the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import constants as K
from ..operators import dedup as D


@dataclass
class Cleaning:
    exact_groups: DataFrame     # content_hash, group_size, first_id, last_id
    exact_members: DataFrame    # id, content_hash, keeper_id, group_size, is_kept
    similar: DataFrame          # id, leader_id (name pass followers)
    summary: DataFrame          # removed, skipped
    survivors: DataFrame        # the input rows that stay


def clean(files: DataFrame, *, id_col: str, content_col: str, name_col: str,
          threshold: float = K.FUZZY_THRESHOLD) -> Cleaning:
    exact_removed = D.exact_removed(files, id_col, content_col)
    similar = D.fuzzy_groups(files, id_col, name_col, threshold)
    removed = exact_removed.unionByName(similar.select(id_col))
    return Cleaning(D.exact_groups(files, id_col, content_col), D.exact_members(files, id_col, content_col),
                    similar, D.removal_sets(exact_removed, similar, id_col), D.survivors(files, removed, id_col))
