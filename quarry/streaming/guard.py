"""Listings checked against those seen before as they stream in: state by day, read by the day itself and the day before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import plain

RESULT = "id long, outcome string, matches array<long>"
#: What a session needs: the state store that knows times to live, and no batches without rows, of which these would never come to an end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class SeenBefore(StatefulProcessor):
    """State of a day: of its listings and the next day's, for each (title, day) and (venue, day) the first id, and all keys.

    A listing goes to its own day, where it is judged, and to the day before, where it is only kept; so each state has all it needs.
    """

    def __init__(self, keep_days: int):
        self.keep = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("text", StringType()), StructField("day", StringType())])
        first = StructType([StructField("id", LongType())])
        ttl = self.keep * 86_400_000
        self.titles, self.venues = handle.getMapState("titles", text, first, ttl), handle.getMapState("venues", text, first, ttl)
        self.known = handle.getMapState("known", StructType([StructField("key", StringType())]), first, ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = str(key[0])
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        titles = {tuple(k): v[0] for k, v in self.titles.iterator()}
        venues = {tuple(k): v[0] for k, v in self.venues.iterator()}
        known: dict[str, int | None] = {}  # of the batch's keys the first id: one call to the state a key, not three a listing
        near: dict[str, list[int]] = {}  # of the batch's titles the ids of those that match, kept up as titles come in
        match = lambda t, u: bool(t and u) and (t in u or u in t)
        out = []
        for id_, k, title, venue, on, judged in zip(*(batch[c].tolist() for c in ("id", "key", "title", "venue", "day", "judged")), strict=True):
            if judged:
                if k not in known:
                    known[k] = self.known.getValue((k,))[0] if self.known.containsKey((k,)) else None
                same = known[k]
                if title not in near:
                    near[title] = sorted({i for (t, _), i in titles.items() if match(t, title)})
                first = venues.get((venue, day)) if venue else None
                found = near[title] if first is None or first in near[title] else sorted([*near[title], first])
                out.append((id_, "already_exists" if same is not None else "possible_duplicate" if found else "created", [same] if same is not None else found))
            if title and (title, on) not in titles:
                for t, ids in near.items():
                    if match(t, title) and id_ not in ids:
                        near[t] = sorted([*ids, id_])
            for text, seen, state in ((title, titles, self.titles), (venue, venues, self.venues)):
                if text and (text, on) not in seen:
                    seen[(text, on)] = id_
                    state.updateValue((text, on), (id_,))
            if judged and known[k] is None:
                known[k] = id_
                self.known.updateValue((k,), (id_,))
        yield pd.DataFrame(out, columns=["id", "outcome", "matches"])

    def close(self) -> None:
        pass


def guarded(listings: DataFrame, keep_days: int = 400) -> DataFrame:
    """id, outcome, matches of a stream of listings(id, key, title, venue, day, at), judged in order of (at, id) as they come.

    already_exists: a listing of that day with the same key came before; possible_duplicate: one whose title holds this one's or is held by it on the same or
    the next day, or one at the same venue on the same day; else created. Matches are the first listings with each such title and venue.
    Refused listings are remembered as well. Blank titles and venues match nothing; a listing without a day is left out. State is kept
    `keep_days` after it was last written and needs the RocksDB state store (see SETTINGS); a day's state holds its different titles.
    """
    rows = listings.where("day is not null").select("id", F.col("key").cast("string").alias("key"), plain(F.col("title")).alias("title"), plain(F.col("venue")).alias("venue"), F.col("day").cast("string").alias("day"), "at")
    both = rows.withColumn("_d", F.explode(F.array(F.struct(F.col("day").alias("state_day"), F.lit(True).alias("judged")), F.struct(F.date_sub(F.col("day").cast("date"), 1).cast("string").alias("state_day"), F.lit(False).alias("judged")))))
    keyed = both.select("_d.state_day", "_d.judged", "id", "key", "title", "venue", "day", "at")
    return keyed.groupBy("state_day").transformWithStateInPandas(statefulProcessor=SeenBefore(keep_days), outputStructType=RESULT, outputMode="Append", timeMode="ProcessingTime")
