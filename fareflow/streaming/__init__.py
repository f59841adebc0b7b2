"""Structured Streaming operators (payment webhooks, daily commissions, booking state)."""

import uuid

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory - the shared
    folder a cluster names in ``spark.checkpoint.dir`` - for stream inputs,
    sinks and checkpoints.  Never a machine-local temp folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
