"""Reports of users: which are taken, and for which place."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import nearest

STATUSES = ("open", "closed", "congested", "slow", "idf", "police", "inspection")


def taken_in_turn(rows: DataFrame, who: str, seconds: str, order: str, most: int = 10, within: float = 60.0) -> DataFrame:
    """``rows`` with ``taken``: at most ``most`` of one ``who`` within the last ``within`` seconds.

    A row that is not taken does not count for later ones, so rows are gone
    through in order of ``seconds`` and ``order``, with only the last ``most``
    taken in memory.  Rows without ``who`` are taken.
    """
    named = rows.filter(F.col(who).isNotNull())
    schema = rows.schema.add("taken", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, deque(maxlen=most)
        for pdf in batches:
            out = []
            for name, now in zip(pdf[who].tolist(), pdf[seconds].tolist()):
                if name != current:
                    current, last = name, deque(maxlen=most)
                free = len(last) < most or now - last[0] > within
                if free:
                    last.append(now)
                out.append(free)
            yield pdf.assign(taken=pd.Series(out, index=pdf.index, dtype=bool))

    dealt = named.repartition(who).sortWithinPartitions(who, seconds, order)
    return dealt.mapInPandas(run, schema).unionByName(rows.filter(F.col(who).isNull()).withColumn("taken", F.lit(True)))


def user_reports(reports: DataFrame, places: DataFrame, statuses: tuple[str, ...] = STATUSES, most: int = 10, within: float = 60.0, most_km: float = 0.5) -> DataFrame:
    """(id, outcome, place, km) of reports (id, reporter, seconds, key, status, lat, lon).

    A status that is not one of ``statuses`` is ``invalid``, a report beyond
    ``most`` of its reporter in ``within`` seconds ``rate_limited``.  Others are
    ``applied`` to the place of their key, if it is one of ``places`` (key, p_lat,
    p_lon), or else to the nearest within ``most_km``.  What is left is a
    ``candidate`` if it has a key, and ``recorded`` if not.  Ids are unique.
    """
    valid = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    rows = reports.select("id", "reporter", F.col("seconds").cast("double").alias("seconds"), "key", "status", "lat", "lon")
    turned = taken_in_turn(rows.filter(valid), "reporter", "seconds", "id", most, within)
    known = places.select(F.col("key").alias("place")).distinct()
    named = turned.filter("taken").join(known, F.col("key") == F.col("place"), "left")
    lost = named.filter("place is null and lat is not null and lon is not null").select("id", "lat", "lon")
    near = nearest(lost, places, "id", "key", most_km).withColumnRenamed("name", "near")
    placed = named.join(near, "id", "left").withColumn("place", F.coalesce("place", "near"))
    outcome = F.when(F.col("place").isNotNull(), "applied").when(F.length(F.trim("key")) > 0, "candidate").otherwise("recorded")
    refused = lambda df, why: df.select("id", F.lit(why).alias("outcome"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("double").alias("km"))
    out = placed.select("id", outcome.alias("outcome"), "place", "km")
    return out.unionByName(refused(turned.filter(~F.col("taken")), "rate_limited")).unionByName(refused(rows.filter(~valid), "invalid"))
