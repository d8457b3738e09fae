"""A standing watch over listings: each micro-batch of listing rows is diffed with the index and merged.

A stream never tells of removals, so what is gone is left to a scan pass."""

from pyspark.sql import DataFrame

from mirrorlake.operators import review
from mirrorlake.plans.scan import outcomes
from mirrorlake.sources.catalogue import Catalogue
from mirrorlake.sources.shared import stash


def merge_batch(index: str):
    """foreachBatch function over rows rel_path, abs_path, size_bytes, mtime_seconds. Running a batch again
    after a failure gives the same index, because what is already merged diffs as unchanged."""

    def merge(batch: DataFrame, epoch: int) -> None:
        from pyspark.sql import functions as F

        catalogue = Catalogue(batch.sparkSession, index)
        rows = stash(batch.dropDuplicates(["rel_path"]), "batch")
        state = review.scan_diff(rows, catalogue.known()).where("state in ('new', 'changed')")
        found = outcomes(rows.join(state.select("rel_path"), "rel_path", "left_semi"))
        good = found.where("outcome = 'indexed'").withColumn("fingerprint_version", F.lit(review.FINGERPRINT_VERSION).cast("long"))
        if not good.isEmpty():
            catalogue.upsert(good.drop("outcome", "message", "staged"), epoch)
        bad = found.where("outcome != 'indexed'")
        if not bad.isEmpty():
            catalogue.not_pictures(bad.select("rel_path", "size_bytes", "mtime_seconds"), epoch)

    return merge


def watch(listings: DataFrame, index: str, checkpoint: str, once=False):
    """Start the stream; with once it takes what is there and ends."""
    writer = listings.writeStream.foreachBatch(merge_batch(index)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
