"""Near copies by word shingles: Jaccard similarity at or above a threshold, verified on the shingle sets.

Rows of equal shingle sets are one node from the start. Nodes that share a band
of ``ROWS`` min-hashes out of ``BANDS`` meet in a cell; a pair at similarity 0.8
shares none with a chance of about one in eight million. A cell gives at most
one link less than it has nodes, a spanning forest of its verified links, and
compares only nodes that no link has joined yet. The first bands, dealt alone,
join most copies, so that hardly any cell of the others is left to compare.

A cell of more than ``SWEEP`` nodes is dealt to parts, each with the cell's
first node: all are compared with that one and with their part. They also meet
in deeper cells, of those that share the bands that follow as well, one more,
then two, four and so on, until no cell is too large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.llm import filters
from scopeledger.llm.common import join_rows, number_rows, ship, stage, text_of
from scopeledger.llm.components import components
from scopeledger.llm.simhash import LOWER

ship(__name__)

BANDS = 40
ROWS = 5
#: Bands whose cells are linked before the others are looked at.
FIRST = 2
#: Nodes that one task compares with one another.
SWEEP = 512
#: Shingles hashed at once.
PART = 1024


def shingles(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Different hashes of the word shingles of a text; fewer words than a shingle count as one."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())])
    return np.unique(np.frombuffer(raw, np.uint64))


def band_keys(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), PART):
        mixed = items[at:at + PART, None] * factors[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).astype(np.int64)


def _signatures(shingle: int, seed: int):
    factors = np.array([xxhash.xxh64_intdigest(f"factor {i}", seed) | 1 for i in range(BANDS * ROWS)], np.uint64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, keys = [], []
                for text in part.column(2):
                    items = shingles(text.as_py(), shingle, seed)
                    names.append(xxhash.xxh128_digest(items.tobytes()))
                    keys.append(band_keys(items, factors))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["_row", "_id", "name", "bands"])

    return run


def _sets(bits: bytes, shingle: int, seed: int):
    """Shingle sets of the rows that are in the bitmap."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.column(0).slice(at, 1024).to_pylist()
                some = [i for i, row in enumerate(rows) if filters.has(bits, str(row).encode())]
                items = [shingles(batch.column(1)[at + i].as_py(), shingle, seed).astype(np.int64) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i] for i in some], pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["node", "items"])

    return run


def forest(nodes: list[int], labels: list[int], sets: list[np.ndarray], at_least: float) -> list[tuple[int, int]]:
    """Verified links between the labels of nodes of a cell that are alike, directly or through others; equal labels are joined already."""
    root = {label: label for label in labels}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    found = []
    for i in range(len(nodes) - 1):
        mine = top(labels[i])
        rest = [j for j in range(i + 1, len(nodes)) if top(labels[j]) != mine]
        rest = [j for j in rest if min(sizes[i], sizes[j]) >= at_least * max(sizes[i], sizes[j]) - 1e-9]
        if not rest:
            continue
        shared = np.add.reduceat(
            np.isin(np.concatenate([sets[j] for j in rest]), sets[i]).astype(np.int64), np.cumsum([0, *sizes[rest][:-1]]))
        for j, both in zip(rest, shared.tolist()):
            if both >= (sizes[i] + sizes[j] - both) * at_least - 1e-9 and top(labels[j]) != top(labels[i]):
                root[top(labels[j])] = top(labels[i])
                found.append((labels[i], labels[j]))
    return found


def _sweep(at_least: float):
    """Links of cells whose rows follow each other."""
    def run(batches):
        held, links = [], []

        def close():
            members = {m[1]: m for m in held}
            nodes = sorted(members)
            links.extend(forest(nodes, [members[n][2] for n in nodes], [members[n][3] for n in nodes], at_least))

        for batch in batches:
            for key, node, label, items in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                if held and held[-1][0] != key:
                    close()
                    held = []
                held.append((key, node, label, items.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
            links = []
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _cells(nodes: DataFrame, bands: range, sweep: int) -> DataFrame:
    """``key, node, label`` of the cells that hold different labels, split until none has more than ``sweep`` nodes."""
    first = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col("bands")[b].alias("key")) for b in bands])).alias("c")
    dealt = nodes.select("node", "label", "bands", first).select("node", "label", "bands", "c.band", F.xxhash64("c.band", "c.key").alias("key"))
    done, width = None, 1
    while True:
        sizes = dealt.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min_by(F.struct("node", "label"), "node").alias("leader"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        open_ = stage(join_rows(dealt, sizes.where("lo <> hi").select("key", "n", "leader"), "key"), "cells")
        small = open_.where(F.col("n") <= sweep).select("key", "node", "label")
        done = small if done is None else done.unionByName(small)
        large = open_.where(F.col("n") > sweep)
        if large.isEmpty():
            return done
        # the first node meets every other one in parts of the cell
        parts = large.withColumn("part", F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("n") / sweep))))
        heads = parts.select(F.col("part").alias("key"), "leader.node", "leader.label").distinct()
        members = parts.where("node <> leader.node").select(F.col("part").alias("key"), "node", "label")
        done = done.unionByName(members).unionByName(heads)
        if width >= BANDS:
            return done
        # the others meet again where they share the bands that follow
        deeper = F.xxhash64("key", F.slice(F.concat("bands", "bands"), F.col("band") + width + 1, F.lit(width)))
        dealt = large.select("node", "label", "bands", "band", deeper.alias("key"))
        width *= 2


def _components(nodes: DataFrame, texts: DataFrame, shingle: int, seed: int, at_least: float, sweep: int, known: DataFrame | None = None) -> DataFrame:
    """``node, component`` of all nodes, over the known links and spanning forests of all cells."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    # a node in no shared cell needs no set; bands of different place have different keys
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    busy = stage(join_rows(bands, shared, "key").select("node").distinct(), "busy")
    bits = filters.bitmap_of(busy, F.col("node").cast("string"))
    sets = stage(texts.select("_row", "_text").mapInArrow(_sets(bits, shingle, seed), "node long, items array<long>"), "shingles")

    def swept(labelled, which):
        rows = join_rows(_cells(labelled, which, sweep), sets, "node").select("key", "node", "label", "items")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_sweep(at_least), "a long, b long")

    def labelled(rows):
        return join_rows(rows, joined, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    active = join_rows(nodes, busy, "node", "left_semi")
    links = swept(active.withColumn("label", F.col("node")), range(FIRST))
    joined = components(links if known is None else links.unionByName(known), "a", "b")
    # further links join labels, so only those are left to be joined
    more = components(swept(labelled(active), range(FIRST, BANDS)), "a", "b").withColumnRenamed("node", "label")
    return join_rows(labelled(nodes.select("node")), more, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def drop_similar(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, at_least: float = 0.8, seed: int = 42, sweep: int = SWEEP,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row of each component of near copies, with the columns of ``docs``.

    Rows are linked if the sets of their word shingles (ASCII letters in lower
    case) have Jaccard similarity ``at_least``; the row of the smallest id stays
    (null last), then the first. A text of fewer words is one shingle; null and
    blank texts are alike. ``docs`` must be a scan of files or staged, as its
    rows are numbered. ``at_least`` under 0.8 finds fewer of its pairs.

    ``known`` gives links between rows, ``_row`` and ``other`` as by
    :func:`simhash.near_rows` of the same ``docs``; shingles add to them.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in at.items()])
    numbered = number_rows(plain.select(F.col(at[doc_id]).alias("_id"), text_of(at[text]).cast("binary").alias("_text")), "_row")
    id_type = numbered.schema["_id"].dataType.simpleString()
    signed = stage(numbered.select("_row", "_id", "_text").mapInArrow(
        _signatures(shingle, seed), f"_row long, _id {id_type}, name binary, bands array<long>"), "signatures")
    order = F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    nodes = stage(signed.groupBy("name").agg(F.min(order).alias("best"), F.first("bands").alias("bands")).select(
        F.col("best.row").alias("node"), "name", "best", "bands"), "nodes")
    if known is not None:
        of_row = join_rows(signed.select("_row", "name"), nodes.select(F.col("best.row").alias("node"), "name"), "name").select("_row", "node")
        a, b = of_row.withColumnRenamed("node", "a"), of_row.select(F.col("_row").alias("other"), F.col("node").alias("b"))
        known = join_rows(join_rows(known, a, "_row"), b, "other").select("a", "b")
    joined = _components(nodes.select("node", "bands"), numbered, shingle, seed, at_least, sweep, known)
    best = join_rows(nodes.select("node", "best"), joined, "node").groupBy("component").agg(F.min("best").alias("best"))
    goes = join_rows(signed.select("_row"), best.select(F.col("best.row").alias("_row")), "_row", "left_anti")
    kept = join_rows(number_rows(plain, "_row"), goes, "_row", "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])
