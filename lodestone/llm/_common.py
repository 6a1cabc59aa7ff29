"""What several operators share: stored tables, word splitting, spans, and what workers keep."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import added  # noqa: F401
from ..plans.storage import stored as store  # noqa: F401
from ..plans.storage import stored_by as store_by  # noqa: F401

#: Words are the maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands in for a missing doc_id in orderings: such rows rank last.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes partitions, so that tasks stay alike at any input size."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def at_least(spark: SparkSession, n: float) -> int:
    """Partitions for n portions of work, and as many as the session shuffles into."""
    return max(int(n) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of packed spans (start in the high half, end in the low)."""
    spans = np.sort(np.asarray(spans, np.int64))
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:], [len(end)])) - 1].tolist()))


_held: dict = {}


def held(name: str, make):
    """What a Python worker keeps from task to task, for one operator at a time."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Frees what another operator's tasks have kept in this worker."""
    import pyarrow as pa

    _held.clear()
    pa.default_memory_pool().release_unused()
