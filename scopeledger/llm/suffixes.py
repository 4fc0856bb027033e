"""Repeated byte strings by distributed prefix doubling over sampled positions.

Positions get ranks of growing prefixes. Inside a task the ranks of all
positions double locally, 1, 2, 4, ... bytes, as hashes of rank pairs, up to
half of the threshold. Of each window of ``size`` bytes the position with the
smallest rank (the last of equal ones) stands for it; the choice depends on the
window's bytes alone, so equal windows choose alike and no repeat is lost.
Spark then sorts the chosen positions by rank and drops the unique ones. The
rest are ranked again at the full threshold: positions of equal rank are sorted
together with the bytes around them, and windows are compared at every offset.
Ranks that very many positions share go through one more grouped count instead
of one task.

Matches never cross texts. Texts that are equal as a whole are settled by
digest; one of them takes part for all.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import join_small, number_rows, ship, stage, text_of

ship(__name__)

#: Bytes ranked together in a task, and positions of one rank that one task compares.
CHUNK = 2 << 20
SHARED = 20_000
LOW = (1 << 24) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length``-byte strings at every position, by doubling; the last ones wrap around and mean nothing."""

    def pair(a, b):
        x = a * ODD
        x ^= x >> np.uint64(29)
        x += b
        x *= MIX
        x ^= x >> np.uint64(32)
        return x

    done, level, width = None, (data.astype(np.uint64) + np.uint64(1)) * MIX, 1
    covered = 0
    while True:
        if length & width:
            done = level if done is None else pair(done, np.roll(level, -covered))
            covered += width
        width *= 2
        if width > length:
            return done
        level = pair(level, np.roll(level, -(width // 2)))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``values[s:s + width]`` for every ``s`` with a whole window."""
    level, reach = values, 1
    while reach * 2 <= width:
        level = np.minimum(level[:-reach], level[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(level[:len(level) - rest], level[rest:]) if rest else level


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """``rank, position, first, last``: chosen positions and the window starts that chose them, in joined texts."""
    half = size // 2
    if len(data) < size:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    rank = ranks(data, half)
    at = np.arange(len(data), dtype=np.uint64)
    coded = (rank & ~np.uint64(LOW)) | (np.uint64(LOW) - at)
    chosen = LOW - (window_minimum(coded[:len(data) - half + 1], size - half + 1) & np.uint64(LOW)).astype(np.int64)
    inside = np.zeros(len(chosen) + 1, np.int8)
    whole = ends - starts >= size
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - size + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    key = np.where(inside, chosen, -1)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.concatenate((edge[1:], [len(key)])) - 1
    real = key[edge] >= 0
    position = key[edge][real]
    return rank[position].astype(np.int64), position, edge[real], last[real]


def _texts(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, without copying."""
    array = batch.column(column)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def _rank_positions(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch, 1)
            rows = batch.column(0).to_numpy()
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
                # a text beyond a chunk is ranked in overlapping parts that choose alike
                for lo in range(int(offsets[at]), max(int(offsets[to]) - size, int(offsets[at])) + 1, CHUNK * 4):
                    hi = min(int(offsets[to]), lo + CHUNK * 4 + size - 1)
                    starts = np.clip(offsets[at:to], lo, hi) - lo
                    ends = np.clip(offsets[at + 1:to + 1], lo, hi) - lo
                    rank, position, first, last = anchors(data[lo:hi], starts, ends, size)
                    owner = at + np.searchsorted(offsets[at:to + 1], position + lo, "right") - 1
                    base = offsets[owner] - lo
                    columns = [rank, rows[owner], position - base, first - base, last - base]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), *[pa.array(c.astype(np.int32)) for c in columns[2:]]],
                        ["rank", "_row", "at", "first", "last"],
                    )
                at = to

    return run


def _surroundings(size: int):
    """Bytes before a position and behind its half, as far as the windows that chose it reach."""
    half = size // 2

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for row, text, spots in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py()
                for spot in spots.as_py():
                    at, first, last = spot["at"], spot["first"], spot["last"]
                    for to, value in zip(out, (spot["rank"], row, at, first, text[first:at], text[at + half:last + size])):
                        to.append(value)
                    if len(out[0]) >= 5000:
                        yield _around(out)
                        out = [[] for _ in range(6)]
            yield _around(out)

    return run


def _around(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["rank", "_row", "at", "first", "before", "behind"])


def repeated_runs(group: list[tuple[bytes, bytes]], half: int, size: int) -> list[list[list[int]]]:
    """For each member of a group of equal rank, the runs of offsets (bytes of the window before the position) repeated in the group.

    Windows are compared at one offset after the other, so no more than one
    window of each member is held.
    """
    counts = Counter(group)
    members = list(counts)
    reach = [(max(size - half - len(behind), 0), len(before)) for before, behind in members]
    runs = [[list(span)] if counts[m] > 1 else [] for m, span in zip(members, reach)]
    if len(members) > 1:
        for r in range(min(lo for lo, _ in reach), max(hi for _, hi in reach) + 1):
            first: dict[bytes, int] = {}
            twice: set[int] = set()
            for i, (before, behind) in enumerate(members):
                if reach[i][0] <= r <= reach[i][1]:
                    other = first.setdefault(before[len(before) - r:] + behind[:size - half - r], i)
                    if other != i:
                        twice.update((other, i))
            for i in twice:
                if counts[members[i]] == 1:
                    if runs[i] and runs[i][-1][1] == r - 1:
                        runs[i][-1][1] = r
                    else:
                        runs[i].append([r, r])
    found = dict(zip(members, runs))
    return [found[m] for m in group]


def _compare(size: int):
    half = size // 2

    def run(batches):
        held: list[tuple] = []
        out: list[list] = [[], [], []]
        for batch in batches:
            for member in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if held and held[-1][0] != member[0]:
                    close(held, out)
                    held = []
                held.append(member)
            yield batch_of(out)
            out = [[], [], []]
        if held:
            close(held, out)
        yield batch_of(out)

    def close(members, out):
        if len(members) < 2:
            return
        for (_, row, at, _, _), runs in zip(members, repeated_runs([(m[3], m[4]) for m in members], half, size)):
            for lo, hi in runs:
                for to, value in zip(out, (row, at - hi, at - lo + size)):
                    to.append(value)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *[pa.array(v, pa.int32()) for v in out[1:]]], ["_row", "a", "b"])

    return run


def _every_window(size: int):
    """One row for each window of a position of a very common rank."""
    half = size // 2

    def run(batches):
        for batch in batches:
            for rank, row, at, before, behind in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                offsets = list(range(size - half - len(behind), len(before) + 1))
                names = [hashlib.blake2b(before[len(before) - r:] + b"|" + behind[:size - half - r], digest_size=16, salt=r.to_bytes(4, "little")).digest() for r in offsets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rank] * len(offsets), pa.int64()), pa.array(names, pa.binary()), pa.array([row] * len(offsets), pa.int64()),
                     pa.array([at - r for r in offsets], pa.int32())], ["rank", "name", "_row", "a"])

    return run


def _cut_out(batches):
    """Bytes left, removed and the runs removed, for a text and its spans (null: none; a negative end: all of it)."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for row, key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            text, merged = text.as_py(), []
            for a, b in sorted((s["a"], s["b"] if s["b"] >= 0 else len(text)) for s in spans.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                elif b > a:
                    merged.append([a, b])
            left, at = [], 0
            for a, b in merged:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            removed = sum(b - a for a, b in merged)
            for to, value in zip(out, (row, key, len(text), removed, merged, hashlib.sha256(b"".join(left)).hexdigest())):
                to.append(value)
        runs = pa.array([[{"a": a, "b": b} for a, b in m] for m in out[4]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array([k.as_py() for k in out[1]], batch.schema.field(1).type), pa.array(out[2], pa.int64()),
             pa.array(out[3], pa.int64()), runs, pa.array(out[5], pa.string())],
            ["_row", "_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def _rows_of(rows: DataFrame, counted: DataFrame, keys: list[str], shared: int) -> DataFrame:
    """Rows whose key is among ``counted`` (keys and their number ``n``, staged).

    Keys of more than ``shared`` rows are looked up where the rows are, so that
    no task gets all rows of one; the others are shuffled.
    """
    hot = counted.where(F.col("n") > shared).select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = [(k, f"_{k}") for k in keys]
    usual = join_small(rows, hot, on, "left_anti").join(counted.where(F.col("n") <= shared), keys, "left_semi")
    return usual.unionByName(join_small(rows, hot, on, "left_semi"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 400, shared: int = SHARED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` for every row of ``docs``.

    ``spans`` are the maximal runs of bytes covered by a ``size``-byte string
    that also starts anywhere else, in the same text or another; the digest is
    that of the bytes left. A null text is empty; texts shorter than ``size``
    lose nothing; repeated rows repeat each other's strings; an empty table
    gives no row; further columns are not looked at. ``docs`` must be a scan of
    files or staged, as its rows are numbered.
    """
    if size < 2:
        raise ValueError("size must be 2 or more")
    base = number_rows(docs.select(F.col(doc_id).alias("_id"), text_of(text).cast("binary").alias("_text")), "_row")
    long_ = base.where(F.length("_text") >= size)
    copies = long_.groupBy(F.sha2("_text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("least"))
    digests = long_.select("_row", F.sha2("_text", 256).alias("digest"))
    copied = stage(digests.join(copies.where("n > 1"), "digest").select("_row", (F.col("_row") == F.col("least")).alias("stands")), "copied")

    ranked = stage(long_.select("_row", "_text").mapInArrow(_rank_positions(size), "rank long, _row long, at int, first int, last int"), "ranks")
    common = stage(ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    taking_part = _rows_of(ranked, common, ["rank"], shared).join(copied.where("not stands"), "_row", "left_anti")
    spots = taking_part.groupBy("_row").agg(F.collect_list(F.struct("rank", "at", "first", "last")).alias("spots"))
    dealt = base.select("_row", "_id", "_text").repartition("_row")
    around = dealt.select("_row", "_text").join(spots, "_row").select("_row", "_text", "spots").mapInArrow(
        _surroundings(size), "rank long, _row long, at int, first int, before binary, behind binary"
    )
    around = stage(around.select("rank", "_row", "at", "before", "behind"), "around")
    sizes = stage(around.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    hot = sizes.where(F.col("n") > shared).select(F.col("rank").alias("_hot"))
    usual = join_small(around, hot, [("rank", "_hot")], "left_anti").join(sizes, "rank", "left_semi")
    few = usual.repartition("rank").sortWithinPartitions("rank", "_row", "at").mapInArrow(_compare(size), "_row long, a int, b int")
    spans = few
    if not hot.isEmpty():
        windows = join_small(around, hot, [("rank", "_hot")], "left_semi").mapInArrow(_every_window(size), "rank long, name binary, _row long, a int")
        twice = stage(windows.groupBy("rank", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
        many = _rows_of(windows, twice, ["rank", "name"], shared).select("_row", "a", (F.col("a") + size).alias("b"))
        spans = spans.unionByName(many)
    whole = copied.select("_row", F.lit(0).alias("a"), F.lit(-1).alias("b"))
    per_row = spans.join(copied, "_row", "left_anti").unionByName(whole).groupBy("_row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    key_type = base.schema["_id"].dataType.simpleString()
    done = dealt.join(per_row, "_row", "left").select("_row", "_id", "_text", "spans").mapInArrow(
        _cut_out, f"_row long, _id {key_type}, n_bytes long, n_removed long, spans array<struct<a: int, b: int>>, kept_sha256 string"
    )
    return done.drop("_row").withColumnRenamed("_id", doc_id)
