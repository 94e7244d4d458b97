"""Line dedup by pairwise alignment.

Lines are compared stripped of white space at their ends; blank lines are left out.  Documents find each other through
shared hashes of rare lines.  A line of at least ``BLOCK_WORDS`` words is one by itself; shorter ones, which are common
alone, count together: hashed is the shortest run of lines that reaches so many words, on from each line and back from
each.  Every common block of so many words holds such a run, whatever the length of its lines, and those inside it
cover it.  Each run links its holders to its first one, the document of smallest id, so thousands of holders give one
link each and not all pairs, and each common block of a document is met in a link to one that holds it.

Each linked pair is aligned with patience diff: lines unique in both are matched along their longest increasing run,
matches are extended over equal neighbours, and the gaps between are treated alike (a gap without unique lines is
split at its rarest common one).  Aligned runs of at least ``BLOCK_WORDS`` words are common blocks and are deleted from
the later document, and so are runs of so many words that both hold but that the alignment crosses.  So exactly the
lines go that stand in a block of so many words which an earlier document holds too; blank lines inside a block go with
it.  The first holder of a block keeps it.

Documents take part in segments of ``SEGMENT`` lines that overlap by a run, so what a pair needs is bounded however
long the texts are.  A segment meets its later ones in parts of ``PART`` links, so a passage in very many documents is
dealt over many tasks.  Lines are shuffled as hashes; texts move once, to meet the numbers of their deleted lines.  The
plan is the same at every size.

Edge cases: null and empty texts stay as they are; a null id takes no part; very long texts are compared whole; rows
with an equal id and text are one document, and of rows with an equal id and other texts the one with the smaller text
hash comes first; lines repeated inside a document alone stay; an empty table gives an empty result; all columns of
``docs`` are kept, and ``n_lines`` and ``n_deleted`` win over columns of the same name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfels.llm.common import forget, in_slices, persist, texts

BLOCK_WORDS = 8
SEGMENT = 1024
PART = 256


def solid_lines(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """A hash, the number of words and the number (from 0) of each line that is not blank."""
    hashes, words, numbers = [], [], []
    for number, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()) - 2**63)
            words.append(n)
            numbers.append(number)
    return hashes, words, numbers


def shortest_runs(words: Sequence[int], block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """Start and end of the shortest runs of ``block_words`` words, on from each line and back from each."""
    sums, least = [0, *accumulate(words)], max(1, block_words)
    on = ((i, bisect_left(sums, before + least)) for i, before in enumerate(sums))
    back = ((bisect_right(sums, up_to - least) - 1, j) for j, up_to in enumerate(sums))
    return sorted({(i, j) for i, j in (*on, *back) if i >= 0 and j < len(sums)})


def segments(text: bytes, block_words: int = BLOCK_WORDS, segment: int = SEGMENT) -> Iterator[tuple[int, list[int], list[int], list[int], list[int]]]:
    """(number, hashes, words, line numbers, hashes of runs) of each segment; each run is in one segment, whole."""
    hashes, words, numbers = solid_lines(text)
    packed = b"".join(x.to_bytes(8, "little", signed=True) for x in hashes)
    step = segment - max(1, block_words)
    runs: dict[int, set[int]] = {}
    for i, j in shortest_runs(words, block_words):
        runs.setdefault(i // step, set()).add(xxhash.xxh3_64_intdigest(packed[8 * i : 8 * j]) - 2**63)
    for k, own in sorted(runs.items()):
        part = slice(k * step, k * step + segment)
        yield k, hashes[part], words[part], numbers[part], sorted(own)


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned pairs of positions, ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: k for k, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        pairs = [(k, where[x]) for k, x in enumerate(a[a0:a1], a0) if x in where]
        if not pairs:
            rarest = min((x for x in in_a if x in in_b), key=lambda x: (in_a[x] * in_b[x], x), default=None)
            if rarest is None:
                continue
            pairs = [(a.index(rarest, a0, a1), b.index(rarest, b0, b1))]
        ends: list[int] = []  # the longest increasing run of positions in b
        last: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(ends, j)
            ends[p : p + 1] = [j]
            last[p : p + 1] = [k]
            back.append(last[p - 1] if p else -1)
        k, chain = last[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        at, bt = a0, b0
        for i, j in reversed(chain):
            todo.append((at, i, bt, j))
            out.append((i, j))
            at, bt = i + 1, j + 1
        todo.append((at, a1, bt, b1))
    return sorted(out)


class Earlier:
    """The lines of the earlier document of some pairs."""

    def __init__(self, lines: Sequence):
        self.lines, self.set, self.runs = lines, set(lines), {}

    def holds(self, run: Sequence) -> bool:
        if not self.set.issuperset(run):
            return False
        n = len(run)
        if n not in self.runs:
            self.runs[n] = {tuple(self.lines[k : k + n]) for k in range(len(self.lines) - n + 1)}
        return tuple(run) in self.runs[n]


def common_lines(later: Sequence, words: Sequence[int], earlier: Earlier, block_words: int = BLOCK_WORDS) -> list[int]:
    """Places of the lines of ``later`` in common blocks of enough words; no line is blank."""
    gone: set[int] = set()
    run: list[int] = []
    before = None
    for i, j in [*patience(later, earlier.lines), (-9, -9)]:
        if before is not None and (i, j) == (before[0] + 1, before[1] + 1):
            run.append(i)
        else:
            if sum(words[k] for k in run) >= block_words:
                gone.update(run)
            run = [i]
        before = (i, j)
    for i, j in shortest_runs(words, block_words):
        if not gone.issuperset(range(i, j)) and earlier.holds(later[i:j]):
            gone.update(range(i, j))
    return sorted(gone)


_SEGMENTS = "doc_id long, h long, seg int, hashes array<long>, words array<int>, numbers array<int>, runs array<long>"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _segments(block_words: int, segment: int):
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [(d, h, *s) for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))) for s in segments(t, block_words, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, _TYPES)], names)

    return run


def _align(block_words: int):
    """Rows come sorted by earlier segment and part, the earlier segment itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, earlier = None, Earlier(())
        for batch in batches:
            out = []
            for *own, role, doc_id, h, hashes, words, numbers in zip(*[batch.column(k).to_pylist() for k in range(10)]):
                if role == 0:
                    key, earlier = own, Earlier(hashes)
                    continue
                assert own == key
                gone = common_lines(hashes, words, earlier, block_words)
                lines = {numbers[k] for k in gone}
                for k, after in zip(gone, gone[1:]):
                    if after == k + 1:
                        lines.update(range(numbers[k], numbers[after]))
                out += [(doc_id, h, x) for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "h", "line"])

    return run


def deleted_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, segment: int = SEGMENT, part: int = PART, used: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, h, gone): which lines to delete of each document that has any, 64 to a long; h: xxhash64 of the text.

    used: gets the persisted tables that the result reads.
    """
    keyed = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    parts = persist(keyed.mapInArrow(_segments(block_words, segment), _SEGMENTS))
    anchors = parts.select("doc_id", "h", "seg", F.explode("runs").alias("run"))
    first = anchors.groupBy("run").agg(F.min(F.struct("doc_id", "h", "seg")).alias("f"), F.max(F.struct("doc_id", "h")).alias("l"))
    # this and what follows is written, so that both sides of each join are exchanges and a hot key can be split
    first = persist(first.filter("f.doc_id <> l.doc_id or f.h <> l.h").select("run", F.col("f.doc_id").alias("f_id"), F.col("f.h").alias("f_h"), F.col("f.seg").alias("f_seg")))
    links = anchors.join(first.hint("merge"), "run").filter("doc_id <> f_id or h <> f_h").select("doc_id", "h", "seg", "f_id", "f_h", "f_seg")
    links = persist(links.distinct())
    earlier_key, later_key = ["f_id", "f_h", "f_seg"], ["doc_id", "h", "seg"]
    dealt = persist(links.groupBy(*earlier_key).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")))
    if used is not None:
        used += [parts, first, links, dealt]
    once = parts.drop("runs").dropDuplicates(later_key)
    holders = once.join(dealt.hint("merge"), [F.col(a) == F.col(b) for a, b in zip(later_key, earlier_key)])
    holders = holders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("role", F.lit(0))
    links = links.join(dealt.hint("merge"), earlier_key).withColumn("part", F.pmod(F.xxhash64(*later_key), F.col("parts")).cast("int"))
    later = links.join(once.hint("merge"), later_key).withColumn("role", F.lit(1))
    columns = [*earlier_key, "part", "role", "doc_id", "h", "hashes", "words", "numbers"]
    rows = holders.select(*columns).unionByName(later.select(*columns))
    rows = rows.repartition(*earlier_key, "part").sortWithinPartitions(*earlier_key, "part", "role")
    gone = rows.mapInArrow(_align(block_words), "doc_id long, h long, line int")
    words = gone.groupBy("doc_id", "h", F.expr("shiftright(line, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, line % 64))").alias("b"))
    maps = words.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("top"))
    return maps.select("doc_id", "h", F.expr("transform(sequence(0, top), w -> coalesce(try_element_at(m, w), 0L))").alias("gone"))


def line_dedup(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with shortened texts, n_lines (before) and n_deleted; settings are those of :func:`deleted_lines`."""
    docs = docs.drop("n_lines", "n_deleted")
    used: list[DataFrame] = []
    gone = persist(deleted_lines(docs, **settings, used=used))
    forget(*used)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("gone").alias("_gone"))
    # the side of the numbers is hashed and the texts stream past it, unsorted; the plan does not depend on sizes
    out = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("int"))
    deleted = F.expr("aggregate(_gone, 0L, (n, b) -> n + bit_count(b))")
    out = out.withColumn("n_deleted", F.when(F.col("_gone").isNull(), 0).otherwise(deleted).cast("int"))
    left = F.expr(r"array_join(filter(split(text, '\n', -1), (x, k) -> coalesce(shiftrightunsigned(get(_gone, shiftright(k, 6)), k & 63) & 1L, 0L) = 0), '\n')")
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    return out.select(*docs.columns, "n_lines", "n_deleted")


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the deleted lines and without the documents of which nothing but blank lines is left."""
    out = line_dedup(docs, **settings).filter((F.col("n_deleted") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
