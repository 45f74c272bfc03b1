"""Keeping an index current from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborsim.operators import embed, maintain
from arborsim.schema import IndexMeta
from arborsim.sources.index_store import IndexStore

#: So many folders of appended rows are put into one.
FOLDERS = 32


def stream_update(blobs: DataFrame, store: IndexStore, embedder: embed.Embedder, checkpoint: str) -> StreamingQuery:
    """Embeds what arrives in the stream blobs(path, blob_sha, content) and isn't indexed yet.

    A batch appends its own rows only. Batches may be delivered twice; contents that are indexed are skipped, so the
    result is the same. Runs until what is available is done; start it again for what came since.
    """

    def one(batch: DataFrame, _: int) -> None:
        meta, index = store.load()
        ready = maintain.readable(maintain.new_entries(batch, index)).groupBy("blob_sha").agg(F.first("content").alias("content"))
        store.append(embed.embed(ready, embedder), IndexMeta(meta.version, embedder.model, embedder.dims))
        if len(store.current()["dirs"]) > FOLDERS:
            store.compact()

    return blobs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
