"""SHA-256 of a group's texts joined in order, streamed through sorted partitions: no group is ever held in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridlark.llm.common import in_small_batches


def joined_sha256(rows: DataFrame, key: str, order: list[str], piece: str, separator: str) -> DataFrame:
    """key, sha256 (lowercase hex) of the UTF-8 of each key's pieces in order, with the separator between them.

    Pieces and keys aren't null. A hash over a sequence needs one task a key; what it holds is one batch, and the rows are sorted with spilling.
    """
    between = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            keys, found = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and k == held:
                    digest.update(between)
                else:
                    if digest is not None:
                        keys.append(held)
                        found.append(digest.hexdigest())
                    held, digest = k, hashlib.sha256()
                digest.update(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], names=[key, "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], batch.schema.field(0).type), pa.array([digest.hexdigest()])], names=[key, "sha256"])

    kind = dict(rows.dtypes)[key]
    dealt = in_small_batches(rows).select(key, piece, *order).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, f"`{key}` {kind}, sha256 string")
