"""Column functions over the change history."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from churnscope.config import DAY

AUTOMATION_MARKS = ("bot", "automation", "noreply")


def bulk_weight(files: Column) -> Column:
    """1 for commits of up to 10 files, then falling with the root, never under 0.1."""
    return F.when(files <= 10, F.lit(1.0)).otherwise(F.greatest(F.sqrt(F.lit(10.0) / files), F.lit(0.10)))


def recency_weight(head_ts: Column, ts: Column, half_life_days: int = 730) -> Column:
    """One half to the power of the age in half-lives, to the last bit as the C library has it.

    The JVM's ``pow`` differs from it in the last bit now and then, and owners whose
    scores are equal but for that bit would change places. Each age of a batch is raised once.
    """
    @F.pandas_udf("double")
    def halved(ages: pd.Series) -> pd.Series:
        known, places = np.unique(ages.to_numpy(), return_inverse=True)
        return pd.Series(np.array([math.pow(0.5, x) for x in known])[places], dtype="float64")

    return halved(F.greatest(head_ts - ts, F.lit(0)) / F.lit(float(DAY)) / F.lit(float(half_life_days)))


def sustained_activity_weight(commits: Column) -> Column:
    return F.when(commits <= 0, 0.0).when(commits == 1, 0.25).when(commits == 2, 0.60).otherwise(1.0)


def ceil_div(value: Column, by: int) -> Column:
    return F.expr("null") if by == 0 else F.floor((value + (by - 1)) / by)


def age_days(head_ts: Column, first_ts: Column) -> Column:
    """Whole days, at least 0; null if either is null (greatest alone would skip it)."""
    days = F.when(head_ts >= first_ts, F.floor((head_ts - first_ts) / DAY)).otherwise(F.lit(0))
    return F.when(head_ts.isNotNull() & first_ts.isNotNull(), days).cast("long")


def looks_automated(author: Column) -> Column:
    test = F.lit(False)
    for mark in AUTOMATION_MARKS:
        test = test | F.lower(author).contains(mark)
    return test


def parse_count(text: Column) -> Column:
    """A change count; anything but a number, such as ``-`` for binaries, is 0."""
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0).cast("bigint"))


def merge_heavy(first_parent: Column, reachable: Column, merges: Column) -> Column:
    """Whether first-parent history hides much of the work."""
    many = (first_parent >= 4) & (merges >= 3) & (4 * merges >= first_parent)
    hidden = (reachable >= first_parent + 3) & (4 * reachable >= 5 * F.greatest(first_parent, F.lit(1)))
    return many | hidden


def history_confidence(mode: Column, bounded: Column) -> Column:
    return F.when(mode.isin("incremental", "up_to_date"), "incremental").when(bounded, "bounded").otherwise("first_parent_only")
