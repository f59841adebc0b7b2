"""Streams with keyed state in the engine (``transformWithState``).

The state of a key lives in the state store, on the executor that owns the
key's partition: a micro-batch reads and writes the states of the keys it names,
whatever the size of the table that the states began with.  The engine
versions the store with every batch, and the file sink keeps a log of the
batches it holds, so a batch that runs again after a failure starts from the
states before it and adds its rows once.

The key is a bucket of ids (``bucket_of``), and its state holds the ids of the
bucket in arrays: a call to the store costs far more than the id it is for, and
a task makes a few per bucket, not a few per id.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of a stream's ids, fixed for good (a checkpoint keeps its states by
#: them): 10 million ids are some 2,500 a bucket.
STATE_BUCKETS = 1 << 12


def bucket_of(id_: Column) -> Column:
    """Bucket of an id (of one type in a stream and in its initial states)."""
    return F.pmod(F.xxhash64(id_), F.lit(STATE_BUCKETS)).cast("int").alias("bucket")


def with_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, initial: DataFrame,
               pandas: bool = False) -> DataFrame:
    """Rows that ``processor`` gives for each key of a micro-batch; ``initial``
    (one row per key) is loaded into the store by the first batch.  The
    processor takes and gives rows, or frames of them (``pandas``: far less work per row).
    Its module travels by value: the engine also runs it in a process
    beside the driver that knows no shipped packages."""
    cloudpickle.register_pickle_by_value(sys.modules[type(processor).__module__])
    keyed = stream.groupBy(key)
    run = keyed.transformWithStateInPandas if pandas else keyed.transformWithState
    return run(processor, schema, "append", "none", initialState=initial.groupBy(key))


def start_to_files(rows: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Append a stream's rows to Parquet files, all that is there now (``availableNow``)."""
    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)                         # transformWithState needs this store
    try:
        return (rows.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)
