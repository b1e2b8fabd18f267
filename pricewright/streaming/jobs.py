"""Incremental jobs: listings into versioned tables, and windowed event counts.

The scheduled jobs of the pricing service become streams that take what is
there and stop (``availableNow``).  Both restart from their checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricewright.operators import versions
from pricewright.operators.listings import first_of, total_order
from pricewright.operators.mutations import upsert


def ingest(new: DataFrame, folder: str, checkpoint: str, keys: tuple[str, ...] = ("source", "listing_id")) -> StreamingQuery:
    """Upsert a stream of listings into the versioned table in ``folder``, one version a batch.

    A pointer notes the stream and the batch it came from: a batch that runs again
    after a crash finds itself served and does nothing.  A stream whose checkpoint
    was lost is a new one, and goes on from the table that is served.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = versions.stream_id(spark, checkpoint)

        def change(base: versions.Pointer | None):
            if base is not None and base.notes.get("stream") == stream and base.notes["batch"] >= number:
                return None
            rows = first_of(batch, keys, total_order(batch, *keys))
            return rows if base is None else upsert(versions.read(spark, folder, pointer=base), rows, keys)

        versions.update(spark, folder, change, f"batch{number}", {"stream": stream, "batch": number})

    return new.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by window and kind; a window is final once the watermark has passed it."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    counts = rows.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def price_alerts(listings: DataFrame, snapshots: DataFrame, share: float = 0.85) -> DataFrame:
    """Listings of a stream priced below a share of their segment's median, by a join with the served snapshots."""
    keys = ["make", "model", "variant", "year"]
    rows = listings.join(snapshots.select(*keys, "p50"), keys)
    return rows.where(F.col("price") < share * F.col("p50"))
