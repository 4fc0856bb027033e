"""Ranked search with geometric blocks of posting lists and exact bounds.

The index keeps, for every document, the terms that any query has. Documents
that are alike lie in one chunk of at most ``CHUNK``. In a chunk each term's
posting list is clustered: some of its documents are centres, the others join
the nearest, and clusters of at most ``BLOCK`` documents are blocks. A block
stores the coordinatewise maximum of its documents.

Terms are ordered by falling weight. A document is found in the list of the
first query term that it has, so the bound of a block needs only the query's
terms from the list's own on: the sum of weight times the block's maximum. The
documents of the blocks with the highest bounds give each query a threshold, the
score of its k-th best so far; a block is skipped only if its bound is lower.
All others are scored in full, so the result is exact.

Queries are taken in blocks of limited size, each a pass over the index.
"""

from __future__ import annotations

import collections
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.llm import filters
from scopeledger.llm.common import ship, stage, text_of

ship(__name__)

CHUNK = 2048
BLOCK = 32
#: Pairs of query and term in a block of queries; a longer query makes a block of its own.
QUERY_TERMS = 8192
#: Blocks of the highest bounds that set a query's threshold.
SEEDS = 8
SIGNATURE = 16
#: Terms a task remembers to be in no query.
REMEMBERED = 1 << 20
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters beyond ASCII; only A-Z in lower case."""
    return text.translate(TERM_BYTES).split()


def saturation(tf: np.ndarray, n: int, documents: int, length: int) -> np.ndarray:
    """What a term's occurrences in a document of ``n`` terms count for, before its weight."""
    m = 75 + 25 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _query_terms(batches):
    for batch in batches:
        for text in batch.column(0):
            found = list(set(terms_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["term"])


def _vectors(bits: bytes):
    def run(batches):
        wanted = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keep, sizes, terms, tfs = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    found = terms_of(text.as_py())
                    if not found:
                        continue
                    mine = []
                    for term, tf in collections.Counter(found).items():
                        if (ok := wanted.get(term)) is None:
                            ok = wanted[term] = filters.has(bits, term)
                        if ok:
                            mine.append((term, tf))
                    keep.append(i)
                    sizes.append(len(found))
                    terms.append([t for t, _ in mine])
                    tfs.append([n for _, n in mine])
                if len(wanted) > REMEMBERED:
                    wanted = {}
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    return run


class Queries:
    """A block of queries in numbers: terms by falling weight, each query's terms and what each counts for."""

    def __init__(self, found: list[tuple[object, collections.Counter]], weights: dict[bytes, int]):
        self.ids = [i for i, _ in found]
        names = sorted({t for _, c in found for t in c if t in weights}, key=lambda t: (-weights[t], t))
        self.number = {t: i for i, t in enumerate(names)}
        self.terms, self.worth = [], []
        self.holders = [[] for _ in names]
        for q, (_, counter) in enumerate(found):
            pairs = sorted((self.number[t], c * weights[t]) for t, c in counter.items() if t in self.number)
            self.terms.append(np.array([p[0] for p in pairs], np.int64))
            self.worth.append(np.array([p[1] for p in pairs], np.int64))
            for t, _ in pairs:
                self.holders[t].append(q)
        self.weight = np.array([weights[t] for t in names], np.int64)
        self.beside = {}

    def coordinates(self, term: int) -> np.ndarray:
        """Terms from ``term`` on that any query has beside it."""
        if term not in self.beside:
            found = np.unique(np.concatenate([self.terms[q] for q in self.holders[term]]))
            self.beside[term] = found[found >= term]
        return self.beside[term]


def _place(queries: Queries, documents: int, length: int, bits: int):
    """Documents in the numbers of a block of queries, with the leading bits of a signature of signed sums."""
    planes = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (max(len(queries.number), 1), SIGNATURE))

    def run(batches):
        names = pa.array(list(queries.number), pa.binary())
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lists = part.column(2)
                rows = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                cols = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy()
                tf, n = part.column(3).flatten().to_numpy(), part.column(1).to_numpy()
                order = np.lexsort((cols, rows))
                order = order[cols[order] >= 0]
                rows, cols = rows[order], cols[order]
                sat = saturation(tf[order], n[rows], documents, length)
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                side = np.add.reduceat((queries.weight[cols] * sat).astype(np.float32)[:, None] * planes[cols], starts) > 0 if len(rows) else np.zeros((0, SIGNATURE), bool)
                near = np.packbits(side, axis=1, bitorder="big").view(">u2").reshape(-1).astype(np.int64) >> (SIGNATURE - bits)
                offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(near), part.column(0).take(pa.array(rows[starts], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(cols.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(sat.astype(np.int32)))], ["near", "id", "cols", "sats"])

    return run


def _dense(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, the terms that occur, and the matrix of saturations of a chunk, by row number."""
    table = table.sort_by("uid")
    lists = table.column("cols").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    cols = lists.flatten().to_numpy()
    sats = table.column("sats").combine_chunks().flatten().to_numpy()
    used, at = np.unique(cols, return_inverse=True)
    matrix = np.zeros((table.num_rows, len(used)), np.int32)
    matrix[np.repeat(np.arange(table.num_rows), sizes), at] = sats
    return table.column("uid").to_numpy(), used, matrix


def cluster(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of ``points`` in clusters of at most ``size``: the nearest of evenly spaced rows by cosine."""
    n = len(points)
    if n <= size:
        return [np.arange(n)]
    unit = points.astype(np.float32)
    unit /= np.maximum(np.sqrt((unit * unit).sum(1, keepdims=True)), 1e-9)
    nearest = (unit @ unit[::size].T).argmax(1)
    order = np.argsort(nearest, kind="stable")
    ends = np.cumsum(np.bincount(nearest))
    return [group[k:k + size] for group in np.split(order, ends[:-1]) for k in range(0, len(group), size)]


BLOCKS = "near long, sub long, block int, term int, members array<long>, coords array<int>, maxima array<int>"
PLACE = ["near", "sub"]


def _build_blocks(queries: Queries, block: int):
    def run(table: pa.Table) -> pa.Table:
        uids, used, matrix = _dense(table)
        place = np.full(len(queries.number), -1, np.int64)
        place[used] = np.arange(len(used))
        terms, members, coords, maxima = [], [], [], []
        for at, term in enumerate(used.tolist()):
            rows = np.flatnonzero(matrix[:, at])
            beside = place[queries.coordinates(term)]
            beside = beside[beside >= 0]
            part = matrix[rows[:, None], beside]
            for group in cluster(part, block):
                top = part[group].max(0)
                some = np.flatnonzero(top)
                terms.append(term)
                members.append(uids[rows[group]])
                coords.append(used[beside[some]])
                maxima.append(top[some])
        n = len(terms)
        return pa.table({
            "near": pa.array(np.repeat(table.column("near")[0].as_py(), n), pa.int64()),
            "sub": pa.array(np.repeat(table.column("sub")[0].as_py(), n), pa.int64()),
            "block": pa.array(np.arange(n), pa.int32()), "term": pa.array(terms, pa.int32()), "members": _lists(members, np.int64),
            "coords": _lists(coords, np.int32), "maxima": _lists(maxima, np.int32)})

    return run


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind)))


def _bounded(queries: Queries, batch: pa.RecordBatch):
    """``row, query, bound`` for every block of a batch and every query that has its term."""
    full = np.zeros(len(queries.number), np.int64)
    offsets = batch.column("coords").offsets.to_numpy()
    coords, maxima = batch.column("coords").values.to_numpy(), batch.column("maxima").values.to_numpy()
    low = batch.column("maxima").offsets.to_numpy()
    for i, term in enumerate(batch.column("term").to_pylist()):
        where = coords[offsets[i]:offsets[i + 1]]
        full[where] = maxima[low[i]:low[i + 1]]
        for q in queries.holders[term]:
            yield i, q, int(full[queries.terms[q]] @ queries.worth[q])
        full[where] = 0


def _best_bounds(queries: Queries, most: int):
    """``query, bound, near, sub, block`` of each query's ``most`` highest bounds in a task."""
    def run(batches):
        best = [[] for _ in queries.ids]
        for batch in batches:
            near, sub, block = (batch.column(c).to_numpy() for c in ("near", "sub", "block"))
            for i, q, bound in _bounded(queries, batch):
                found = (bound, int(near[i]), int(sub[i]), int(block[i]))
                if len(best[q]) < most:
                    heapq.heappush(best[q], found)
                elif found > best[q][0]:
                    heapq.heapreplace(best[q], found)
        rows = [(q, *found) for q, some in enumerate(best) for found in some]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query", "bound", "near", "sub", "block"])

    return run


def _open_blocks(queries: Queries, least: dict[int, int]):
    """``near, sub, members, asked``: the blocks that may hold a document good enough for some queries, and those queries."""
    def run(batches):
        for batch in batches:
            asked = collections.defaultdict(list)
            for i, q, bound in _bounded(queries, batch):
                if bound >= least.get(q, 1):
                    asked[i].append(q)
            rows = pa.array(list(asked), pa.int64())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(rows) for c in (*PLACE, "members")], pa.array(list(asked.values()), pa.list_(pa.int32()))],
                [*PLACE, "members", "asked"])

    return run


def _score(queries: Queries, k: int):
    """The ``k`` best documents of a chunk for each query that asks for some of its blocks."""
    def run(key, asked: pa.Table, chunk: pa.Table) -> pa.Table:
        out = {"query": [], "id": [], "uid": [], "score": []}
        if asked.num_rows and chunk.num_rows:
            chunk = chunk.sort_by("uid")
            uids, used, matrix = _dense(chunk)
            ids = chunk.column("id")
            place = np.full(len(queries.number), -1, np.int64)
            place[used] = np.arange(len(used))
            members = asked.column("members").combine_chunks()
            rows, ends = np.searchsorted(uids, members.flatten().to_numpy()), np.cumsum([0, *pc.list_value_length(members).to_pylist()])
            wanted = collections.defaultdict(list)
            for i, some in enumerate(asked.column("asked").to_pylist()):
                for q in some:
                    wanted[q].append(i)
            for q, blocks in wanted.items():
                mine = np.zeros(len(uids), bool)
                for i in blocks:
                    mine[rows[ends[i]:ends[i + 1]]] = True
                mine = np.flatnonzero(mine)
                cols = place[queries.terms[q]]
                score = matrix[mine[:, None], cols[cols >= 0]].astype(np.int64) @ queries.worth[q][cols >= 0]
                limit = max(np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 1, 1)
                best = [(-int(score[i]), (at := ids[int(mine[i])].as_py()) is None, at, int(uids[mine[i]])) for i in np.flatnonzero(score >= limit)]
                for negative, _, at, uid in sorted(best)[:k]:
                    out["query"].append(q)
                    out["id"].append(at)
                    out["uid"].append(uid)
                    out["score"].append(-negative)
        return pa.table({
            "query": pa.array(out["query"], pa.int32()), "id": pa.array(out["id"], chunk.schema.field("id").type),
            "uid": pa.array(out["uid"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    return run


def index_documents(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_text: str = "text") -> DataFrame:
    """Staged ``id, n, terms, tfs`` of every document with a term: how many terms it has, and those some query may have."""
    terms = queries.select(text_of(query_text).cast("binary").alias("t")).mapInArrow(_query_terms, "term binary")
    bits = filters.bitmap_of(terms, F.col("term"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).alias("id"), text_of(text).cast("binary").alias("t"))
    return stage(plain.mapInArrow(_vectors(bits), f"id {id_type}, n long, terms array<binary>, tfs array<long>"), "vectors")


def query_blocks(queries: DataFrame, item_id: str, text: str, most: int):
    """Queries as ``(id, terms)`` in lists of at most ``most`` pairs of query and term, read one after the other."""
    held, size = [], 0
    for row in queries.select(F.col(item_id).alias("i"), text_of(text).alias("t")).toLocalIterator():
        found = collections.Counter(terms_of(row.t.encode()))
        if held and size + len(found) > most:
            yield held
            held, size = [], 0
        held.append((row.i, found))
        size += len(found)
    if held:
        yield held


def _search_block(spark: SparkSession, vectors: DataFrame, dfs: DataFrame, found: list, documents: int, length: int, k: int, chunk: int, block: int):
    """``query, id, score, rank`` of one block of queries, its blocks of posting lists, and those that were not skipped."""
    names = spark.createDataFrame([(bytearray(t),) for t in {t for _, c in found for t in c}], "term binary")
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = {bytes(r.term): r.w for r in dfs.join(F.broadcast(names), "term").select("term", weight.alias("w")).collect()}
    queries = Queries(found, weights)
    id_type = vectors.schema["id"].dataType.simpleString()
    bits = int(np.clip(np.ceil(np.log2(max(documents / chunk, 1))), 0, SIGNATURE))
    placed = stage(vectors.mapInArrow(
        _place(queries, documents, length, bits), f"near long, id {id_type}, cols array<int>, sats array<int>"), "placed")
    # at most 2 ** SIGNATURE rows
    crowds = placed.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("subs"))
    row = F.monotonically_increasing_id()
    numbered = stage(placed.join(F.broadcast(crowds), "near").withColumn("uid", row).withColumn(
        "sub", F.pmod(F.xxhash64("uid"), "subs")).drop("subs"), "chunks")
    blocks = stage(numbered.groupBy("near", "sub").applyInArrow(_build_blocks(queries, block), BLOCKS), "blocks")

    def scored(asked: DataFrame) -> DataFrame:
        best = asked.groupBy(*PLACE).cogroup(numbered.groupBy(*PLACE)).applyInArrow(
            _score(queries, k), f"query int, id {id_type}, uid long, score long")
        order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    tops = blocks.drop("members").mapInArrow(_best_bounds(queries, SEEDS), "query int, bound long, near long, sub long, block int")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.col("bound").desc(), *PLACE, "block"))
    seeds = tops.withColumn("nth", nth).where(F.col("nth") <= SEEDS)
    # a block of queries bounds the seeds and the thresholds
    asked = blocks.select(*PLACE, "block", "members").join(F.broadcast(seeds), [*PLACE, "block"])
    first = scored(asked.select(*PLACE, "members", F.array("query").alias("asked")))
    least = {r.query: max(r.score, 1) for r in first.where(F.col("rank") == k).collect()}
    open_ = stage(blocks.mapInArrow(_open_blocks(queries, least), "near long, sub long, members array<long>, asked array<int>"), "open")
    return stage(scored(open_), "ranked"), blocks, open_


def search(
    docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    query_text: str = "text", chunk: int = CHUNK, block: int = BLOCK, most: int = QUERY_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each query: ``item_id, rank, doc_id, score``.

    A term's weight falls with the number of documents that hold it, its
    occurrences saturate, and longer documents count less; a repeated query term
    counts again. Scores are whole numbers above 0; equal ones rank by id (null
    last), then by row. Null and empty texts have no terms: such documents are
    never found, such queries find nothing. Rows with equal ids are ranked each;
    an empty table on either side gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    vectors = index_documents(docs, queries, doc_id, text, query_text)
    documents, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    id_type, item_type = docs.schema[doc_id].dataType.simpleString(), queries.schema[item_id].dataType
    out = spark.createDataFrame([], f"{item_id} {item_type.simpleString()}, rank int, {doc_id} {id_type}, score long")
    if not documents:
        return out
    dfs = stage(vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    for found in query_blocks(queries, item_id, query_text, most):
        best, _, _ = _search_block(spark, vectors, dfs, found, documents, length, k, chunk, block)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(found)], f"query int, {item_id} {item_type.simpleString()}")
        out = out.unionByName(best.join(F.broadcast(names), "query").select(
            item_id, F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score"))
    return out
