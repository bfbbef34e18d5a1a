"""The admission feed as a stream.

Requests arrive as files; each distinct digest is judged once, and every package keeps its history in the order of
arrival. State is keyed, so a key is handled by one task at a time. The stream gives the verdicts that the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUEST = "ecosystem string, name string, version string, digest string, decision string, seen_at timestamp"
HISTORY = "ecosystem string, name string, version string, digest string, decision string, seen_at timestamp, seq long"


def requests(spark: SparkSession, path: str, schema: str = REQUEST, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def judged_once(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """The first request of each digest. With a delay, digests are remembered that long by event time, so the state is
    bounded; without, for good."""
    if delay is None:
        return stream.dropDuplicates(["digest"])
    return stream.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["digest"])


def history(stream: DataFrame) -> DataFrame:
    """Each package's history: entries in order of arrival (of one batch by time, then digest), a digest once, with a
    gapless seq. State is the digests of one package."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        known = set(seen)
        rows = pd.concat(list(batches)).sort_values(["seen_at", "digest"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.digest not in known:
                known.add(r.digest)
                out.append((key[0], key[1], r.version, r.digest, r.decision, r.seen_at, len(seen)))
                seen.append(r.digest)
        state.update((seen,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(", ")])

    return stream.groupBy("ecosystem", "name").applyInPandasWithState(step, HISTORY, "digests array<string>", "append", GroupStateTimeout.NoTimeout)


def fresh_metadata(stream: DataFrame, ttl_seconds: int) -> DataFrame:
    """url, fetched_at, expires_at of each answer, for a sink that upserts by url."""
    return stream.select("url", "body", "content_type", "fetched_at", (F.col("fetched_at") + F.make_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def judge_batches(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], verdicts_path: str, checkpoint: str):
    """Start a query that judges each batch's new digests and appends their verdicts. A batch that is run again after a
    failure finds its verdicts there and adds none twice."""

    def step(batch: DataFrame, _: int) -> None:
        from palisade.sources.sinks import read_or_none

        new = batch.dropDuplicates(["digest"])
        held = read_or_none(batch.sparkSession, verdicts_path)
        if held is not None:
            new = new.join(held.select("digest"), "digest", "left_anti")
        judge(new).write.mode("append").parquet(verdicts_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
