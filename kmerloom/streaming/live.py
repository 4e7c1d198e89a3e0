"""Mapping reads as they arrive, against an index built once. Reads are independent, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kmerloom.operators.mapper import Corpus, build_index, map_reads
from kmerloom.params import Params


def map_stream(reads: DataFrame, segments: DataFrame, p: Params, out: str, checkpoint: str, text: bool = False, once: bool = True) -> StreamingQuery:
    """Write the mappings of a stream of reads as Parquet, one folder per batch, so a repeated batch replaces itself."""
    index = build_index(segments, p, text)
    index.sketch.persist()

    def each(batch: DataFrame, number: int) -> None:
        mapped = map_reads(Corpus(segments, batch, text), p, index)
        mapped.mappings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
