"""Stateful streams: a bounded seen-window for each feed, and near duplicates found as they arrive.

Both keep their state by key in Spark's state store, so the work of a micro-batch grows with its rows and with the state of
the keys that they touch, not with all that has been stored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewrack.operators.dedup import nearest_before, sample_rows

SEEN_URLS = 5_000


def seen_window(stream: DataFrame, feed: str = "feed", url: str = "url", order: str = "position", cap: int = SEEN_URLS) -> DataFrame:
    """The rows (feed, url, order, as strings and a long) whose url is not among the last `cap` distinct ones of its feed.

    Rows of a micro-batch are taken by order, rows of equal order by url; seeing a url again makes it the newest, and beyond
    cap the oldest is forgotten. Null feeds are one feed, null urls are passed over.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = OrderedDict.fromkeys(state.get[0] if state.exists else [])
        rows = pd.concat(list(parts)).sort_values(["at", "url"], kind="stable")
        fresh = []
        for address in rows["url"]:
            fresh.append(address not in window)
            window[address] = None
            window.move_to_end(address)
            if len(window) > cap:
                window.popitem(last=False)
        state.update((list(window),))
        yield rows.loc[fresh, ["feed", "url", "at"]]

    rows = stream.select(F.col(feed).cast("string").alias("feed"), F.col(url).cast("string").alias("url"), F.col(order).cast("long").alias("at")).filter("url IS NOT NULL")
    found = rows.groupBy("feed").applyInPandasWithState(step, "feed string, url string, at long", "urls array<string>", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("feed").alias(feed), F.col("url").alias(url), F.col("at").alias(order))


def near_links(stream: DataFrame, masks: list[tuple[int, int]], most: int) -> DataFrame:
    """stream: nid (rising with arrival), hi, lo: signatures of documents that are no exact copies. nid, d, other: the nearest earlier one by sample of bits, within most bits.

    masks are those of dedup.sample_masks, for the number of documents that the stream is expected to have; a sample's
    signatures with the same bits are one key of the state. dedup.nearest_earlier over all rows at once finds the same.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(state.get[0], dtype=np.int64).reshape(-1, 3) if state.exists else np.zeros((0, 3), dtype=np.int64)
        fresh = np.concatenate([p[["nid", "hi", "lo"]].to_numpy(dtype=np.int64) for p in parts])
        every = np.concatenate([known, fresh])
        state.update((every.tobytes(),))
        bits = np.ascontiguousarray(every[:, 1:]).view(np.uint64)
        found = list(nearest_before(every[:, 0], bits, np.arange(len(known), len(every)), np.arange(len(every)), most))
        if found:
            yield pd.DataFrame(found, columns=["nid", "d", "other"]).astype("int64")

    rows = sample_rows(stream.filter("hi IS NOT NULL"), masks)
    return rows.groupBy("seg", "key_hi", "key_lo").applyInPandasWithState(step, "nid long, d long, other long", "seen binary", "append", GroupStateTimeout.NoTimeout)


def nearest(links: DataFrame) -> DataFrame:
    """Of the links that samples have found the nearest of each document, ties to the earlier other."""
    return links.groupBy("nid").agg(F.min(F.struct("d", "other")).alias("m")).select("nid", "m.d", "m.other")
