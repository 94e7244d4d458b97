"""Content-addressed block stores: in memory, buffered, and as a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornfels.functions.content import PREFIX, cbor, cid, decode, links_of
from hornfels.sources.scratch import exists, materialize, new_folder


class MemoryBlocks:
    """A dictionary of blocks by content id."""

    def __init__(self):
        self.blocks: dict[bytes, bytes] = {}

    def has(self, content_id: bytes) -> bool:
        return content_id in self.blocks

    def get(self, content_id: bytes) -> bytes | None:
        return self.blocks.get(content_id)

    def put(self, block: bytes) -> bytes:
        key = cid(block)
        self.blocks[key] = block
        return key

    def put_many(self, blocks: Iterable[bytes]) -> list[bytes]:
        return [self.put(b) for b in blocks]

    def put_keyed(self, content_id: bytes, block: bytes) -> None:
        self.blocks[content_id] = block

    def put_many_keyed(self, blocks: Mapping[bytes, bytes]) -> None:
        self.blocks.update(blocks)

    def put_value(self, value: Any) -> bytes:
        return self.put(cbor(value))

    def get_value(self, content_id: bytes) -> Any:
        """The decoded block, None if it is not there."""
        block = self.get(content_id)
        return None if block is None else decode(block)


class BufferedBlocks(MemoryBlocks):
    """Keeps blocks until those that a root reaches are flushed to a base store."""

    def __init__(self, base: MemoryBlocks):
        super().__init__()
        self.base = base

    def has(self, content_id: bytes) -> bool:
        return super().has(content_id) or self.base.has(content_id)

    def get(self, content_id: bytes) -> bytes | None:
        return super().get(content_id) or self.base.get(content_id)

    def flush(self, root: bytes) -> None:
        """Move the blocks reachable from ``root``; absent ones are skipped, unreachable ones stay buffered."""
        todo, seen = [root], set()
        while todo:
            key = todo.pop()
            if key in seen:
                continue
            seen.add(key)
            if not key.startswith(PREFIX):
                raise ValueError("only dag-cbor blocks with sha2-256 ids can be flushed")
            block = self.blocks.pop(key, None)
            if block is not None:
                self.base.put_keyed(key, block)
                todo += links_of(block)


@F.udf(T.ArrayType(T.BinaryType()), useArrow=True)
def _links(block):
    return links_of(block)


class BlockTable:
    """Blocks as a table (cid, block) for stores beyond one machine; puts append and are idempotent."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        """folder: where the blocks are; by default one that goes with the application."""
        self.spark, self.folder = spark, folder or new_folder(spark)

    @property
    def table(self) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], "cid binary, block binary")
        return self.spark.read.schema("cid binary, block binary").parquet(self.folder)

    def put(self, blocks: DataFrame) -> None:
        """Add rows (cid, block) that are not there yet."""
        new = blocks.select("cid", "block").dropDuplicates(["cid"]).join(self.table, "cid", "left_anti")
        materialize(new).write.mode("append").parquet(self.folder)

    def put_many(self, blocks: Iterable[bytes]) -> list[bytes]:
        """Add blocks from the driver."""
        rows = [(cid(b), b) for b in blocks]
        self.put(self.spark.createDataFrame(rows, "cid binary, block binary"))
        return [r[0] for r in rows]

    def has(self, ids: DataFrame) -> DataFrame:
        """(cid, there) for each distinct id."""
        there = self.table.select("cid").withColumn("there", F.lit(True))
        return ids.select("cid").distinct().join(there, "cid", "left").select("cid", F.coalesce("there", F.lit(False)).alias("there"))

    def get(self, ids: DataFrame) -> DataFrame:
        return self.table.join(ids.select("cid").distinct(), "cid", "left_semi")

    def reachable(self, root: bytes) -> DataFrame:
        """The blocks that ``root`` reaches, by a breadth-first search over the links."""
        edges = materialize(self.table.select("cid", F.explode(_links("block")).alias("to")))
        seen = new = self.spark.createDataFrame([(root,)], "cid binary")
        while not new.isEmpty():
            new = materialize(edges.join(new, "cid").select(F.col("to").alias("cid")).distinct().join(seen, "cid", "left_anti"))
            seen = seen.unionByName(new)
        return self.get(seen)
