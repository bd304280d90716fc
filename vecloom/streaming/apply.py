"""The mutation log applied by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..database import Collection

POLL = "50 milliseconds"


def log_stream(collection: Collection, max_files: int = 2048) -> DataFrame:
    """The log as a stream of typed ops; log files appear whole, by rename."""
    reader = collection.spark.readStream.schema(collection.log_type).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
    return collection.typed(reader.json(collection.files.at("log")))


def start(collection: Collection, checkpoint: str, once: bool = False, source: DataFrame | None = None) -> StreamingQuery:
    """Folds each micro-batch into a new snapshot. Batches may be replayed: ops already applied are skipped.
    ``source`` is another stream of typed ops (seq, op, doc_id, vector, meta) in order of seq.
    The stream owns the log's application while it runs; ``once`` applies what is there and stops."""
    ops = log_stream(collection) if source is None else source
    stream = ops.writeStream.foreachBatch(lambda batch, _: collection.apply_ops(batch)).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if once else stream.trigger(processingTime=POLL).start()
