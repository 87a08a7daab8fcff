"""Cutting lineage through the folder all executors share, with small batches of texts on their way to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import storage
from ..storage import discard, new_folder, shared_dir

__all__ = ["discard", "materialize", "new_folder", "shared_dir"]

#: rows of an Arrow batch at most while a table is written: a batch of texts is held several times on both sides
ROWS = 2048
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str, **how) -> DataFrame:
    """``storage.materialize`` with at most ``ROWS`` rows in an Arrow batch."""
    conf = df.sparkSession.conf
    before = conf.get(_SETTING)
    conf.set(_SETTING, str(min(int(before), ROWS) if int(before) > 0 else ROWS))
    try:
        return storage.materialize(df, label, **how)
    finally:
        conf.set(_SETTING, before)
