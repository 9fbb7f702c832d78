"""Linking records as they arrive: a stream of new queries against stored target keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import BASE, NormProfile, prepared
from ..operators import blocking
from ..storage import written


def target_index(targets: DataFrame, path: str, profile: NormProfile = BASE, cap: int = blocking.KEY_CAP) -> None:
    """Writes the targets' keys with their rarities, and their token counts, both by country, which batches prune by."""
    view = written(blocking.base_view(prepared(targets, profile)), "view")
    dfs = blocking.token_df(view)
    dfs.write.mode("overwrite").partitionBy("country").parquet(f"{path}/tokens")
    keys = written(blocking.keys(view, dfs), "keys")
    index = blocking.target_index(keys, view.count(), cap)
    index.repartition("country", "k").sortWithinPartitions("country", "k").write.mode("overwrite").partitionBy("country").parquet(f"{path}/keys")


def link_batch(queries: DataFrame, path: str, profile: NormProfile = BASE, k: int = blocking.TOP_K) -> DataFrame:
    """Candidate pairs of a batch of queries with the stored targets.

    Stored rows carry their weights, so the index is read once, only of the batch's countries, and not shuffled to be made
    distinct. The batch's view is written, as its tokens and its countries are read from it.
    """
    spark = queries.sparkSession
    view = written(blocking.base_view(prepared(queries, profile)), "batch")
    here = [r.country for r in view.select("country").distinct().collect()]  # as few as there are countries
    of = lambda name, schema: spark.read.schema(f"{schema}, country string").parquet(f"{path}/{name}").where(F.col("country").isin(here))
    asked = blocking.keys(view, of("tokens", "kind string, t string, df long"))
    pairs = blocking.candidate_pairs(asked, of("keys", "k string, t long, noaddr boolean, w double"))
    return blocking.top_k(blocking.ranked(pairs), k)


def link_stream(queries: DataFrame, path: str, out: str, checkpoint: str, profile: NormProfile = BASE) -> StreamingQuery:
    """Each micro-batch's candidate pairs to a folder of their own, so that a batch that runs again replaces its output."""

    def sink(batch: DataFrame, epoch: int) -> None:
        link_batch(batch, path, profile).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and mean value by type and window, with a watermark; the same plan serves streams and tables."""
    kind = dict(events.dtypes)["ts"]
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks are of instants, not of local times
    w = w.withWatermark("ts", late) if events.isStreaming else w
    counts = w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return counts.select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "mean_value")
