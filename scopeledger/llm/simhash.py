"""SimHash near duplicates found through distance tables to pivot fingerprints.

Each different fingerprint gets a row of Hamming distances to reference
fingerprints, the pivots. By the triangle inequality two fingerprints within
``bits`` differ by at most ``bits`` in every coordinate of the table, so a pair
with a larger coordinate difference is discarded; survivors are verified.

Rows that can be within reach are brought together by equal blocks: if at most
``bits`` bits differ, at least ``blocks - bits`` of the blocks are equal. The
dealt rows are sorted by key in each task; a group is swept along its first
pivot coordinate, and one link per row at most leaves it (a spanning forest),
never all its pairs. A group too large for a sweep is linked by equal one-bit
variants instead, which is linear in its size and exact as well.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import join_rows, number_rows, ship, stage, text_of
from scopeledger.llm.components import components

ship(__name__)

BITS = 64
N_PIVOTS = 16
BLOCKS = 6
#: Largest group swept in one task; larger ones go through variants.
SWEEP = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random bits."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", seed=7) for i in range(n)], np.uint64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included; no word gives zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())])
    counts = np.zeros(BITS, np.int64)
    for at in range(0, 8 * n, 8 << 13):
        part = np.frombuffer(raw, np.uint8, min(8 << 13, 8 * n - at), at).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str, shingle: int, seed: int) -> DataFrame:
    """``keep`` and a signed long ``fp`` with the fingerprint's bits."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*keep, "fp"])

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, text_of(text).cast("binary").alias("_text")).mapInArrow(run, f"{schema}, fp long")


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near(fps: np.ndarray, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``bits`` among one group's fingerprints: both ends of each link."""
    distances = np.bitwise_count(fps[:, None] ^ table[None, :]).astype(np.int8)
    order = np.argsort(distances[:, 0], kind="stable")
    fps, distances = fps[order], distances[order]
    root = np.arange(len(fps))
    a, b = [], []
    to = np.searchsorted(distances[:, 0], distances[:, 0] + bits, "right")
    for i in range(len(fps)):
        rest = np.arange(i + 1, to[i])
        rest = rest[root[rest] != root[i]]
        if not len(rest):
            continue
        rest = rest[(np.abs(distances[rest] - distances[i]) <= bits).all(1)]  # the pivots' verdict
        for j in rest[np.bitwise_count(fps[rest] ^ fps[i]) <= bits]:  # verified
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                a.append(fps[i])
                b.append(fps[j])
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _swept(bits: int, n_pivots: int):
    table = pivots(n_pivots)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            rows = rows if held is None else np.concatenate((held, rows), axis=1)
            new = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            starts = np.flatnonzero(np.concatenate(([True], new)))
            held = rows[:, starts[-1]:]
            yield links(starts, rows[2, :starts[-1]].view(np.uint64))
        if held is not None:
            yield links(np.array([0, held.shape[1]]), np.ascontiguousarray(held[2]).view(np.uint64))

    def links(starts, fps):
        """Groups of two at once, larger ones one by one."""
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        a, b = fps[two], fps[two + 1]
        x, y = (np.bitwise_count(v[:, None] ^ table[None, :]).astype(np.int8) for v in (a, b))
        ok = (np.abs(x - y) <= bits).all(1)
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(a ^ b) <= bits
        found = [(a[ok], b[ok])]
        for at, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
            found.append(near(fps[at:at + size], bits, table))
        a, b = (np.concatenate(x).astype(np.uint64).astype(np.int64) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = 2, blocks: int = BLOCKS, n_pivots: int = N_PIVOTS, sweep: int = SWEEP) -> DataFrame:
    """``a, b``: links between the different fingerprints ``fp`` that join exactly those within ``bits``."""
    masks = block_masks(blocks)
    keys = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]
    dealt = distinct.select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m in keys])).alias("band", "mask")).select(
        "band", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    # groups of one are dropped; sizes decide the way of the others
    sizes = dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    grouped = join_rows(dealt, sizes, ["band", "key"])
    usual = grouped.where(F.col("size") <= sweep).select("band", "key", "fp")
    swept = usual.repartition("band", "key").sortWithinPartitions("band", "key", "fp").mapInArrow(_swept(bits, n_pivots), "a long, b long")
    hot = grouped.where(F.col("size") > sweep).select("band", "fp")
    return swept.unionByName(_by_variants(hot, keys, bits))


def _by_variants(hot: DataFrame, keys: list[int], bits: int) -> DataFrame:
    """Links inside the hot groups: fingerprints within two bits share a variant at most one bit from each.

    Only bits outside the group's key are flipped. Every row is linked to the
    smallest fingerprint that has the variant, if that is within ``bits``; with
    two bits or less it always is.
    """
    if bits > 2:
        raise ValueError("variants of one bit reach two bits only")
    flips = F.array(*[
        F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(BITS) if not mask >> i & 1]) for mask in keys
    ])
    made = hot.select("band", "fp", F.explode(F.element_at(flips, F.col("band") + 1)).alias("flip")).select(
        "band", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant")
    )
    least = made.groupBy("variant").agg(F.min("fp").alias("a"))
    pairs = join_rows(made.select("variant", "fp").distinct(), least, "variant").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    if bits == 2:
        return pairs
    exact = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return exact if bits else pairs.limit(0)


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, bits: int = 2, **kw
) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` for every row; ``fingerprint`` is the signed long.

    Components are the groups reachable over links of at most ``bits`` differing
    bits; ``component_id`` is their smallest id (null ids only if there is no
    other). A null or blank text has fingerprint zero and is linked like any
    other; fewer words than a shingle count as one shingle. ``kept`` marks one
    row of each component, the first of the smallest id, also where rows repeat.
    An empty table gives no row; further columns are not looked at. ``docs``
    must be a scan of files or staged, as its rows are numbered.
    """
    members = _members(docs, doc_id, text, shingle, seed, bits, **kw)
    return members.select(
        F.col("_id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id", (F.col("_row") == F.col("keep_row")).alias("kept")
    )


def _prints(docs: DataFrame, doc_id: str, text: str, shingle: int, seed: int) -> DataFrame:
    """``_row, _id, fp`` of all rows, staged."""
    numbered = number_rows(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_source")), "_row")
    return stage(fingerprints(numbered, ["_row", "_id"], "_source", shingle, seed), "simhash")


def _members(docs: DataFrame, doc_id: str, text: str, shingle: int, seed: int, bits: int, **kw) -> DataFrame:
    rows = _prints(docs, doc_id, text, shingle, seed)
    first = F.min(F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    distinct = rows.groupBy("fp").agg(first.alias("first"))
    found = components(links(distinct.select("fp"), bits, **kw), "a", "b")
    linked = join_rows(distinct, found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    of_fp = join_rows(linked, least, "component").select(
        "fp", F.col("least.id").alias("component_id"), F.col("least.row").alias("keep_row")
    )
    return join_rows(rows, of_fp, "fp")


def near_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, bits: int = 2, **kw) -> DataFrame:
    """``_row, other``: links between rows that join exactly the components of :func:`near_groups`, which are not built here.

    Row numbers are those of :func:`number_rows` on ``docs``.
    """
    rows = _prints(docs, doc_id, text, shingle, seed)
    distinct = stage(rows.groupBy("fp").agg(F.min("_row").alias("first")), "fingerprints")
    copies = join_rows(rows, distinct, "fp").where("_row <> first").select("_row", F.col("first").alias("other"))
    a, b = distinct.select(F.col("fp").alias("a"), F.col("first").alias("_row")), distinct.select(F.col("fp").alias("b"), F.col("first").alias("other"))
    return copies.unionByName(join_rows(join_rows(links(distinct.select("fp"), bits, **kw), a, "a"), b, "b").select("_row", "other"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, bits: int = 2, **kw) -> DataFrame:
    """One row of each component of :func:`near_groups`, with the columns of ``docs``."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(c).alias(n) for c, n in at.items()])
    members = _members(plain, at[doc_id], at[text], shingle, seed, bits, **kw)
    stays = members.where(F.col("_row") == F.col("keep_row")).select("_row")
    kept = join_rows(number_rows(plain, "_row"), stays, "_row", "left_semi")
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])
