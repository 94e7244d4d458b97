"""Content ids, block stores, logical time, epochs, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from hornfels.catalogue import register_program
from hornfels.functions.aggregates import count
from hornfels.functions.content import Link, cbor, cid, decode, fact_cid, links_of, text
from hornfels.plans.builder import Program
from hornfels.sources.blocks import BlockTable, BufferedBlocks, MemoryBlocks
from hornfels.sources.facts import InputTuple, from_columns
from hornfels.streaming.client import Client
from hornfels.streaming.clock import Timestamp
from hornfels.streaming.streams import stream_into
from hornfels.types import from_any, pack

WRITES = [(0, 0, 0, []), (0, 0, 2, [0]), (0, 0, 4, [1]), (0, 0, 5, [1]), (0, 1, 5, []), (0, 0, 6, [0]), (0, 0, 16, [0]), (0, 0, 9, [4]), (0, 0, 22, []), (0, 0, 24, []), (0, 0, 86, [5]), (1, 0, 2, [])]


def writes():
    out = []
    for store, key, value, links in WRITES:
        out.append(InputTuple(store, key, value, tuple(out[k].cid for k in links)))
    return out


def test_content_ids():
    assert text(fact_cid(0, 0, 0)) == "bafyreihpcczta7zqij47wivg2u5juykodp4gfljlyksl4chtppe2ph535a"
    e = [t.cid for t in writes()]
    assert e[2] < e[3] and e[5] < e[1] and e[5] < e[6] and e[0] < e[8] and e[0] > e[9] and e[10] < e[9] and e[11] < e[0]


@pytest.mark.parametrize(("value", "hex_"), [(0, "00"), (23, "17"), (24, "1818"), (1000000, "1a000f4240"), (-1, "20"), (-1000, "3903e7"), (1.5, "fb3ff8000000000000"), ("ü", "62c3bc"), ([1, [2]], "82018102"), ({"a": None}, "a16161f6"), (True, "f5"), (2**64 - 1, "1bffffffffffffffff")])
def test_encoding(value, hex_):
    assert cbor(value).hex() == hex_


def test_links_of_nested_blocks():
    a, b = cid(b"a"), cid(b"b")
    assert links_of(cbor({"x": [1, Link(a), {"y": Link(b)}], "z": "text"})) == [a, b]


def test_block_stores(spark):
    base = MemoryBlocks()
    assert base.get(base.put(b"Hello")) == b"Hello" and not base.has(cid(b"World"))
    buffer = BufferedBlocks(base)
    array = buffer.put_value([1, 2])
    child = buffer.put_value({"array": Link(array)})
    root = buffer.put_value({"child": Link(child), "absent": Link(cid(b"absent"))})
    other = buffer.put_value("apart")
    buffer.flush(root)
    assert all(base.has(k) for k in (root, child, array)) and not base.has(other) and buffer.has(other)
    table = BlockTable(spark)
    rows = spark.createDataFrame([(k, buffer.get(k)) for k in (root, child, array, other)], "cid binary, block binary")
    table.put(rows)
    table.put(rows)
    assert table.table.count() == 4
    assert {bytes(r.cid) for r in table.reachable(root).collect()} == {root, child, array}


def test_clock():
    t = Timestamp(3, 2)
    assert (t.clock_start(), t.epoch_start(), t.advance_epoch(), t.advance_iteration()) == (Timestamp(0, 0), Timestamp(3, 0), Timestamp(4, 0), Timestamp(3, 3))
    a, b = Timestamp(1, 2), Timestamp(2, 1)
    assert a.compare(b) is None and Timestamp(3, 2).join(Timestamp(1, 4)) == Timestamp(3, 4) and a.meet(b) == Timestamp(1, 1) and a.compare(Timestamp(1, 3)) == -1


def test_registers_over_epochs(spark):
    """Rival and repeated writes settle in each epoch as expected."""
    t = writes()
    client = Client(spark, register_program())
    shown = {}
    client.register_sink("head", lambda df: shown.update({(from_any(r.store), from_any(r.key)): from_any(r.value) for r in df.collect()}))
    expected = [(t[:8], {(0, 0): 6, (0, 1): 5}), ([t[8]], {(0, 0): 6}), ([t[9]], {(0, 0): 24}), ([t[10]], {(0, 0): 24}), ([t[11]], {(0, 0): 24, (1, 0): 2})]
    for batch, values in expected:
        client.insert(batch)
        assert client.commit() is not None
        assert values.items() <= shown.items()


def paths():
    p = Program().output("path", {"from": "s32", "to": "s32"})
    p.rule("path", ["s32"] * 2, lambda h, b, x, y: (h.bind({"from": x, "to": y}), b.search("evac", {"entity": x, "attribute": "to", "value": y})))
    return p.rule("path", ["s32"] * 3, lambda h, b, x, y, z: (h.bind({"from": x, "to": z}), b.search("path", {"from": x, "to": y}).search("path", {"from": y, "to": z})))


def pairs(df):
    return sorted((r["from"], r["to"]) for r in df.collect())


def closed(n):
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_monotone_program_emits_each_row_once(spark):
    client = Client(spark, paths())
    got = []
    client.register_sink("path", lambda df: got.extend(pairs(df)))
    for k in (0, 2, 1):
        client.insert(InputTuple(k, "to", k + 1))
        client.commit()
    assert client.monotone and sorted(got) == closed(4) == pairs(client.relation("path"))
    client.insert(InputTuple(0, "to", 1))
    assert client.commit() is None and len(client.events) == 3


def test_rewind_and_replay(spark):
    client = Client(spark, paths())
    for k in range(3):
        client.insert(InputTuple(k, "to", k + 1))
        client.flush()
    client.rewind()
    assert pairs(client.relation("path")) == closed(3)
    client.insert(InputTuple(3, "to", 4))
    assert client.commit() is None  # staged until the latest epoch is active again
    client.rewind()
    assert client.rewind() is None and pairs(client.relation("path")) == closed(2)
    client.replay(), client.replay()
    assert client.replay() is None and pairs(client.relation("path")) == closed(4)
    client.commit()
    assert pairs(client.relation("path")) == closed(5)
    assert client.facts(2).count() == 2 and len(set(client.epoch_ids)) == 4


def test_recomputed_program_and_changes(spark):
    p = Program().output("n", {"n": "s32"})
    p.rule("n", ["s32"], lambda h, b, n: (h.bind({"n": n}), b.group_by(n, "evac", {}, count)))
    client = Client(spark, p)
    seen = []
    client.register_sink("n", lambda new, gone: seen.append(([r.n for r in new.collect()], [r.n for r in gone.collect()])), changes=True)
    client.register_iterable((InputTuple(k, "a", k) for k in range(3)), batch=2)
    client.commit()
    client.insert(InputTuple(9, "a", 9))
    client.commit()
    assert not client.monotone and seen == [([3], []), ([4], [3])]


def test_stream_of_micro_batches(spark, tmp_path):
    source, mark = tmp_path / "in", tmp_path / "mark"
    for k in range(4):
        spark.createDataFrame([(k, k + 1)], "a int, b int").coalesce(1).write.mode("append").parquet(str(source))
    client = Client(spark, paths())
    stream = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 2).parquet(str(source))
    query = stream_into(client, stream, lambda df: from_columns(df, pack(F.col("a"), "s32"), pack(F.lit("to"), "string"), pack(F.col("b"), "s32")), str(mark))
    query.awaitTermination(120)
    assert query.exception() is None and len(client.events) >= 2
    assert pairs(client.relation("path")) == closed(5)


def test_values_through_a_projection(spark):
    p = Program().output("values", {"value": "s64"})
    p.rule("values", ["s64"], lambda h, b, v: (h.bind({"value": v}), b.search("evac", {"entity": "1", "attribute": "value", "value": v})))
    from hornfels.types import Typed

    client = Client(spark, p)
    rows = spark.range(1, 6).select(F.lit("1").alias("e"), "id")
    client.insert_frame(from_columns(rows, pack(F.col("e"), "string"), pack(F.lit("value"), "string"), pack(F.col("id"), "s64")))
    client.commit()
    assert sorted(r.value for r in client.relation("values").collect()) == [1, 2, 3, 4, 5]
    assert fact_cid("1", "value", Typed("s64", 1)) in {bytes(r[0]) for r in client.facts().select("_cid").collect()}


def test_decoding():
    for value in (0, -1, 2**64 - 1, 1.5, "ü", [1, [2, None]], {"a": {"b": b"raw"}, "c": True}, Link(cid(b"x"))):
        assert decode(cbor(value)) == value and type(decode(cbor(value))) is type(value)
    for broken in (b"", b"\x18", b"\x81", b"\x00\x00", b"\xf7", b"\xd8\x2b\x00", b"\x1c"):
        with pytest.raises(ValueError):
            decode(broken)
    store = MemoryBlocks()
    assert store.get_value(store.put_value({"x": [1]})) == {"x": [1]} and store.get_value(b"absent") is None


def test_epoch_ids_chain_every_fact(spark):
    client = Client(spark, paths())
    facts = [InputTuple(k, "to", k + 1) for k in range(4)]
    client.insert(facts[:3]), client.commit()
    client.insert(facts[3]), client.commit()
    first = cid(cbor({"prev": None, "tuples": [Link(x) for x in sorted(f.cid for f in facts[:3])]}))
    assert client.epoch_ids == [first, cid(cbor({"prev": Link(first), "tuples": [Link(facts[3].cid)]}))]


def test_a_log_outlives_its_client(spark, tmp_path):
    log = str(tmp_path / "log")
    client = Client(spark, paths(), log=log)
    for k in range(2):
        client.insert(InputTuple(k, "to", k + 1)), client.commit()
    spark.createDataFrame([], client.facts().drop("epoch").schema).write.parquet(f"{log}/facts/epoch=3")  # of a commit that failed
    again = Client(spark, paths(), log=log)
    assert again.epoch_ids == client.epoch_ids and pairs(again.relation("path")) == closed(3)
    again.insert(InputTuple(0, "to", 1), InputTuple(2, "to", 3)), again.commit()
    assert pairs(again.relation("path")) == closed(4) and again.facts(2).count() == 2 and again.facts().count() == 3
    again.rewind()
    assert pairs(again.relation("path")) == closed(3)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    source, mark, log = (str(tmp_path / x) for x in ("in", "mark", "log"))
    for k in range(2):
        spark.createDataFrame([(k, k + 1)], "a int, b int").coalesce(1).write.mode("append").parquet(source)
        client = Client(spark, paths(), log=log)
        stream = spark.readStream.schema("a int, b int").parquet(source)
        stream_into(client, stream, lambda df: from_columns(df, pack(F.col("a"), "s32"), pack(F.lit("to"), "string"), pack(F.col("b"), "s32")), mark).awaitTermination(120)
        assert pairs(client.relation("path")) == closed(k + 2) and len(client.epoch_ids) == k + 1


def test_block_table_appends(spark, tmp_path):
    table = BlockTable(spark, str(tmp_path / "blocks"))
    assert table.table.count() == 0
    keys = table.put_many([b"a", b"b"])
    table.put_many([b"b", b"c"])
    assert BlockTable(spark, str(tmp_path / "blocks")).table.count() == 3
    there = table.has(spark.createDataFrame([(keys[0],), (cid(b"d"),)], "cid binary")).collect()
    assert {bytes(r.cid): r.there for r in there} == {keys[0]: True, cid(b"d"): False}


def _bytes_to_driver(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


def test_ids_of_a_large_epoch_stay_on_the_executors(spark):
    n = 50_000
    client = Client(spark, paths())
    client.insert_frame(from_columns(spark.range(n), pack(F.col("id"), "s64"), pack(F.lit("at"), "string"), pack(F.col("id"), "s64")))
    before = _bytes_to_driver(spark)
    client.commit()
    assert _bytes_to_driver(spark) - before < n * 36 / 2
    ids = sorted(bytes(r[0]) for r in client.facts().select("_cid").collect())
    assert len(ids) == n and client.epoch_ids == [cid(cbor({"prev": None, "tuples": [Link(x) for x in ids]}))]


def test_content_ids_of_columns_need_no_python(spark):
    """Ids made by expressions equal those of the encoder, for every type and size of a head."""
    from hornfels.sources.facts import from_tuples
    from hornfels.types import RANGES, Typed

    values = [Typed(kind, n) for kind, (low, high) in RANGES.items() for n in {low, high, 0, 23, 24, high // 2, min(high, 255), min(high, 256), min(high, 65535), min(high, 65536), min(high, 2**32 - 1), min(high, 2**32), max(low, -1), max(low, -24), max(low, -25), max(low, -257), max(low, -(2**32) - 1)}]
    values += [Typed("bool", True), Typed("bool", False), Typed("char", "ü"), Typed("cid", cid(b"x")), Typed("cid", b""), Typed("cid", b"y" * 300)]
    values += [Typed(kind, x) for kind in ("f32", "f64") for x in (0.0, -0.0, 1.5, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"))]
    values += [Typed("string", x * n) for x in ("a", "ü", "\0") for n in (0, 1, 23, 24, 255, 256, 70_000)]
    tuples = [InputTuple(v, values[k - 1], values[k - 2], tuple(cid(bytes([j])) for j in range(k % 30))) for k, v in enumerate(values)]
    given = from_tuples(spark, tuples)
    made = from_columns(given.withColumnRenamed("_cid", "expected"), F.col("entity"), F.col("attribute"), F.col("value"), F.col("links"))
    assert "Python" not in made._jdf.queryExecution().toString()
    assert sorted(bytes(r[0]) for r in made.select("_cid").collect()) == sorted(t.cid for t in tuples)
