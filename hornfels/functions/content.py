"""Content ids: DAG-CBOR encoding and CIDv1 (dag-cbor, sha2-256) of input facts.

A fact is the map ``{entity, attr, val, links}`` in this order; a value is a map from the name of its type to the
value; a link is a byte string with a zero byte in front, under tag 42.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfels.types import ANY, FLOATS, NAMES, Typed, literal, payload

_TAG = {"bool": "Bool", "s8": "S8", "u8": "U8", "s16": "S16", "u16": "U16", "s32": "S32", "u32": "U32", "f32": "F32", "s64": "S64", "u64": "U64", "f64": "F64", "char": "Char", "string": "String", "cid": "Cid"}
PREFIX = bytes([0x01, 0x71, 0x12, 0x20])


class Link(bytes):
    """A content id inside a block."""


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * size):
            return bytes([major << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("integer beyond 64 bits")


def cbor(value: Any) -> bytes:
    """DAG-CBOR with map keys in the order given; floats in 64 bits."""
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, Link):
        return _head(6, 42) + _head(2, len(value) + 1) + b"\x00" + value
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    if isinstance(value, Iterable):
        items = [cbor(v) for v in value]
        return _head(4, len(items)) + b"".join(items)
    raise TypeError(f"no encoding for {type(value).__name__}")


def cid(block: bytes) -> bytes:
    """The binary content id of a block; ids order as bytes."""
    return PREFIX + hashlib.sha256(block).digest()


def text(content_id: bytes) -> str:
    """The usual base32 text of an id."""
    return "b" + base64.b32encode(content_id).decode().lower().rstrip("=")


def links_of(block: bytes) -> list[bytes]:
    """The content ids that a DAG-CBOR block links to, in order."""
    out: list[bytes] = []
    at, left = 0, [1]
    while left:
        left[-1] -= 1
        if left[-1] < 0:
            left.pop()
            continue
        major, low = block[at] >> 5, block[at] & 31
        at += 1
        size = {24: 1, 25: 2, 26: 4, 27: 8}.get(low, 0)
        n = int.from_bytes(block[at : at + size], "big") if size else low
        at += size
        if major in (2, 3):
            at += n
        elif major == 4:
            left.append(n)
        elif major == 5:
            left.append(2 * n)
        elif major == 6:
            if n == 42:
                start = at + (2 if block[at] & 31 == 24 else 1)
                length = block[at + 1] if block[at] & 31 == 24 else block[at] & 31
                out.append(bytes(block[start + 1 : start + length]))
            left.append(1)
    return out


def decode(block: bytes) -> Any:
    """The value of a DAG-CBOR block: the inverse of :func:`cbor`; ``ValueError`` if the block is not one value."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(block):
            raise ValueError("a block that ends too early")
        at += n
        return bytes(block[at - n : at])

    def item() -> Any:
        first = take(1)[0]
        major, low = first >> 5, first & 31
        if major == 7:
            if low == 27:
                return struct.unpack(">d", take(8))[0]
            if low not in (20, 21, 22):
                raise ValueError("a value that DAG-CBOR does not have")
            return {20: False, 21: True, 22: None}[low]
        if low > 27:
            raise ValueError("a length that DAG-CBOR does not have")
        n = int.from_bytes(take({24: 1, 25: 2, 26: 4, 27: 8}[low]), "big") if low > 23 else low
        if major < 2:
            return n if major == 0 else -1 - n
        if major == 2:
            return take(n)
        if major == 3:
            return take(n).decode()
        if major == 4:
            return [item() for _ in range(n)]
        if major == 5:
            return {item(): item() for _ in range(n)}
        link = item()
        if n != 42 or not isinstance(link, bytes) or link[:1] != b"\0":
            raise ValueError("a tag that is not a link")
        return Link(link[1:])

    out = item()
    if at != len(block):
        raise ValueError("a block that goes on after its value")
    return out


def _value(v: Any) -> dict:
    typed = v if isinstance(v, Typed) else literal(v, ANY)
    raw = Link(typed.value) if typed.type == "cid" else float(typed.value) if typed.type in FLOATS else typed.value
    return {_TAG[typed.type]: raw}


def fact_block(entity: Any, attribute: Any, value: Any, links: Iterable[bytes] = ()) -> bytes:
    return cbor({"entity": _value(entity), "attr": _value(attribute), "val": _value(value), "links": [Link(x) for x in links]})


def fact_cid(entity: Any, attribute: Any, value: Any, links: Iterable[bytes] = ()) -> bytes:
    return cid(fact_block(entity, attribute, value, links))


def _epoch_head(previous: bytes | None, n: int) -> bytes:
    return _head(5, 2) + cbor("prev") + cbor(None if previous is None else Link(previous)) + cbor("tuples") + _head(4, n)


def epoch_cid(previous: bytes | None, n: int, facts: Iterable[bytes]) -> bytes:
    """Content id of ``{prev, tuples}`` with the ids of ``n`` facts, which are hashed one by one and never held."""
    digest = hashlib.sha256(_epoch_head(previous, n))
    for fact in facts:
        digest.update(cbor(Link(fact)))
    return PREFIX + digest.digest()


PACK = 128
"""Ids that one row brings to the task which hashes them."""


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as rows of up to ``PACK``: the first, how many, and the encoding of all as links."""
    heads: dict[int, bytes] = {}
    for batch in batches:
        ids = batch.column(0).to_pylist()
        links = []
        for x in ids:
            if len(x) not in heads:
                heads[len(x)] = cbor(Link(x))[: -len(x)]
            links.append(heads[len(x)] + x)
        starts = range(0, len(ids), PACK)
        columns = [pa.array([ids[k] for k in starts], pa.binary()), pa.array([len(ids[k : k + PACK]) for k in starts], pa.int64()), pa.array([b"".join(links[k : k + PACK]) for k in starts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["first", "n", "links"])


def epoch_cid_of(ids: DataFrame, previous: bytes | None, n: int) -> bytes:
    """:func:`epoch_cid` of a column of ``n`` ids in ascending order; nothing but the result comes to the driver.

    Tasks sort the ids and encode them in packs.  A SHA-256 over a list is made from its front to its end, so one task
    hashes the packs, which it holds a batch at a time; only their sort, which can spill, sees all of them.
    """
    if not n:
        return epoch_cid(previous, 0, ())
    begin = _epoch_head(previous, n)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = hashlib.sha256(begin), 0
        for batch in batches:
            for links in batch.column(2):
                state.update(links.as_buffer())
            seen += sum(batch.column(1).to_pylist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([PREFIX + state.digest()], pa.binary()), pa.array([seen], pa.int64())], ["id", "n"])

    packs = ids.orderBy(*ids.columns).mapInArrow(_packs, "first binary, n long, links binary")
    made = packs.repartition(1).sortWithinPartitions("first").mapInArrow(digest, "id binary, n long").collect()
    if [r["n"] for r in made] != [n]:
        raise ValueError(f"{n} ids, of which {[r['n'] for r in made]} were hashed")
    return bytes(made[0]["id"])


def _hex(n: int) -> str:
    return f"{n:02x}"


def _head_column(major: int, n: Column) -> Column:
    """:func:`_head` of a column of non-negative integers below 2**64."""
    top = major << 5
    u = F.when(n >= F.lit(Decimal(1 << 63)), n - F.lit(Decimal(1 << 64))).otherwise(n).cast("long")
    digits = F.when(n < 24, F.lpad(F.hex(u + top), 2, "0"))
    for code, size in ((24, 1), (25, 2), (26, 4)):
        digits = digits.when(n < 1 << (8 * size), F.concat(F.lit(_hex(top | code)), F.lpad(F.hex(u), 2 * size, "0")))
    return F.unhex(digits.otherwise(F.concat(F.lit(_hex(top | 27)), F.lpad(F.hex(u), 16, "0"))))


def _link_column(x: Column) -> Column:
    return F.concat(F.lit(_head(6, 42)), _head_column(2, F.octet_length(x) + 1), F.lit(b"\0"), x)


def _value_column(v: Column) -> Column:
    """:func:`cbor` of a value of any type under the name of its type."""
    n, d, text_ = v["i"], F.coalesce(v["d"], F.lit(float("nan"))), v["s"].cast("binary")
    whole = F.when(n >= 0, _head_column(0, n)).otherwise(_head_column(1, -1 - n))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), d).cast("long")
    real = F.concat(F.lit(b"\xfb"), F.unhex(F.lpad(F.hex(bits), 16, "0")))
    string = F.when(text_.isNull(), F.lit(cbor(None))).otherwise(F.concat(_head_column(3, F.octet_length(text_)), text_))
    own = {"i": whole, "d": real, "s": string, "b": _link_column(v["b"])}
    flag = F.when(n == 1, F.lit(cbor(True))).when(n == 0, F.lit(cbor(False)))
    names = raw = None
    for tag, name in enumerate(NAMES):
        there = v["t"] == F.lit(tag).cast("tinyint")
        names = (names if names is not None else F).when(there, F.lit(_head(5, 1) + cbor(_TAG[name])))
    for field in (*own, "bool"):
        tags = [tag for tag, name in enumerate(NAMES) if ("bool" if name == "bool" else payload(name)) == field]
        raw = (raw if raw is not None else F).when(v["t"].isin(tags), flag if field == "bool" else own[field])
    return F.concat(names, raw)


def cid_column(entity: Column, attribute: Column, value: Column, links: Column) -> Column:
    """Content ids of facts, as expressions; the first three are values of any type."""
    tuples = F.aggregate(links, F.lit(b""), lambda made, x: F.concat(made, _link_column(x)))
    block = F.concat(
        *(part for name, v in (("entity", entity), ("attr", attribute), ("val", value)) for part in (F.lit((_head(5, 4) if name == "entity" else b"") + cbor(name)), _value_column(v))),
        F.lit(cbor("links")), _head_column(4, F.size(links)), tuples,
    )
    made = F.concat(F.lit(PREFIX), F.unhex(F.sha2(block, 256)))
    return F.coalesce(made, F.raise_error(F.lit("a fact with a value that has no encoding")).cast("binary"))
