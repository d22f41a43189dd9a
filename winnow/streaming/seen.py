"""New items of a stream, judged against the seen store batch by batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.seen import filter_new
from ..operators.trim import drop_stale
from ..session import freeze
from ..sources.state import SeenStore, write_batch


def new_items_stream(items: DataFrame, store: SeenStore, out: str, as_of, checkpoint: str,
                     retention_days: int = 14, max_age_days: int | None = None):
    """Append each batch's new items to `out`, then mark them.

    Age is tested before the state, since a watermark would not keep undated items. The
    marks come last: a batch that comes again, before or after them, is judged again in full and
    writes the same rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = drop_stale(batch, as_of, max_age_days)
        new = freeze(filter_new(fresh, store.read(batch.sparkSession, as_of, retention_days, f"s{batch_id}"), as_of, retention_days))
        write_batch(new, out, f"s{batch_id}")
        store.mark(new, as_of, f"s{batch_id}")

    return (
        items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# Groups of links in state, for the life of a stream's progress folder.
BUCKETS = 8192
_NEVER = -(1 << 62)


def _judge(retention: int, keep: int):
    """Marks of the links of one bucket: newest time delivered, in microseconds, and the clock in milliseconds when each goes."""

    def run(key, frames, state):
        now = state.getCurrentProcessingTimeMs()
        known = {link: (mark, until) for link, mark, until in zip(*state.get)} if state.exists else {}
        touched = {}
        if not state.hasTimedOut:
            for frame in frames:
                links, times = frame["link"].tolist(), frame["_micros"].to_numpy()
                marks = np.fromiter((known[x][0] if x in known else _NEVER for x in links), np.int64, len(links))
                new = times >= marks + retention
                for link, mark, time in zip(links, marks.tolist(), np.where(new, times, marks).tolist()):
                    touched[link] = max(mark, time, touched.get(link, _NEVER))
                if new.any():
                    yield frame if new.all() else frame[new]
        # links with rows in this batch were judged by their marks, due or not
        live = {link: entry for link, entry in known.items() if entry[1] > now} | {link: (mark, now + keep) for link, mark in touched.items()}
        if not live:
            state.remove()
            return
        state.update((list(live), [m for m, _ in live.values()], [u for _, u in live.values()]))
        state.setTimeoutDuration(min(u for _, u in live.values()) - now)

    return run


def _units(length: str, unit: str) -> int:
    return pd.Timedelta(length) // pd.Timedelta(1, unit)


def keyed_arrivals(items: DataFrame, time: str, retention: str = "14 days", keep: str = "28 days", buckets: int = BUCKETS) -> DataFrame:
    """Items of a stream whose link was not delivered within the retention before them, from state by link.

    All rows of a batch are judged by what earlier batches delivered; repeats inside it all pass. The mark of a link
    is written with the batch's progress: a batch that fails comes again with the marks before it. A late row is judged
    like any other, and is no news once its link was delivered after it. Rows without a link or a time are left
    out. The mark of a link that was quiet for `keep`, by the clock of the cluster, goes; `keep` must exceed
    the retention by the longest delay of the stream.

    Marks lie in `buckets` groups by a hash of the link, since a call for every link would cost far more than its rows.
    The number is fixed with the stream's progress; streams of very many links take more, so that a bucket stays short."""
    rows = items.where((F.coalesce("link", F.lit("")) != "") & F.col(time).isNotNull()).withColumns({
        "_micros": F.unix_micros(F.col(time).cast("timestamp")), "_bucket": F.pmod(F.xxhash64("link"), F.lit(buckets)).cast("int")})
    kept = rows.groupBy("_bucket").applyInPandasWithState(
        _judge(_units(retention, "us"), _units(keep, "ms")), rows.schema,
        "links array<string>, marks array<bigint>, untils array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.select(*items.columns)


def run_available(stream, out: str, checkpoint: str) -> None:
    """Append what the stream has now to the table at `out`, and stop. Batches without data, which would go on for ever to look for state to
    expire, are left to streams that stay up."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set(key, before)
