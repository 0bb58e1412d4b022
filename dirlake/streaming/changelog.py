"""Change records as a stream: the latest state of each entry, kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dirlake.functions.dn import norm_dn


def apply_changes(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """(dn_norm, seq, changes, present) after each batch for every entry it touches, from a stream of (dn, changetype, seq).

    Records of an entry are applied in the order of `seq` within a batch; one that is older than what has been applied
    counts but does not change whether the entry is there. State is one small row for each name, partitioned by it.
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, present = state.get if state.exists else (-1, 0, False)
        for rows in batches:
            count += len(rows)
            newest = rows.loc[rows[seq].idxmax()]
            if newest[seq] > last:
                last, present = int(newest[seq]), newest["changetype"] != "delete"
        state.update((last, count, present))
        yield pd.DataFrame({"dn_norm": [key[0]], "seq": [last], "changes": [count], "present": [present]})

    keyed = changes.select(F.lower(norm_dn(F.col("dn"))).alias("dn_norm"), "changetype", F.col(seq).cast("bigint").alias(seq)).where("dn_norm is not null")
    return keyed.groupBy("dn_norm").applyInPandasWithState(update, "dn_norm string, seq bigint, changes bigint, present boolean", "last bigint, count bigint, present boolean", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(changes: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, changetype, n): change records of each type in each window, with a watermark for late ones."""
    return changes.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "changetype").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "changetype", "n")
