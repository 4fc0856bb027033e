"""Best-fit packing of token sequences under several capacities at once.

Tokens: a batch of texts is cut before each blank that an ordinary character
follows (always a word border of the byte-level tokenizer), Arrow codes the
words, and each different word of the batch is encoded once. Texts in which a
blank is followed by white space, or that hold the special token, are encoded
whole. The result equals the tokenizer's own ids.

Packing: pieces are dealt by hash to groups of some thousands, each packed in
one task. A group's last bins stay part-filled, which costs under a thousandth.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import join_small, number_rows, ship, stage, text_of

ship(__name__)

#: Bytes of text encoded at a time, and pieces packed together.
BATCH_BYTES = 16 << 20
GROUP_PIECES = 2048
#: A blank that white space or the end of the text follows.
LOOSE_BLANK = r" ([\s\x0b\x{85}\p{Z}]|$)"
SPECIAL = "<|endoftext|>"

PIECES = "row long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of many texts at a time from a byte-level vocabulary in its two file forms.

    ``ranks_path`` holds the same vocabulary as ``json_path`` and encodes the
    different words of a batch; ``json_path`` encodes what holds the special token.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in lines)}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)

    def encode_each(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if SPECIAL in t
            else np.array(self.fast.encode_ordinary(t), np.uint32)
            for t in texts
        ]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        out: list = [None] * len(texts)
        loose = pc.or_(pc.match_substring_regex(texts, LOOSE_BLANK), pc.match_substring(texts, SPECIAL))
        loose = loose.to_numpy(zero_copy_only=False)
        for i, ids in zip(np.flatnonzero(loose), self.encode_each(texts.filter(pa.array(loose)).to_pylist())):
            out[i] = ids
        plain = np.flatnonzero(~loose)
        if not len(plain):
            return out
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes, vocabulary = coded.indices.to_numpy(), coded.dictionary
        heads = offsets[:-1]
        firsts = self.encode_each(vocabulary.take(pa.array(codes[heads])).to_pylist())
        ids, begin, count = self._words(vocabulary)
        code_count = count[codes]
        code_count[heads] = 0  # the first word of a text has no blank before it
        ends = np.concatenate(([0], np.cumsum(code_count)))
        spread = np.repeat(begin[codes] - ends[:-1], code_count)
        flat = ids[spread + np.arange(ends[-1])]
        for i, k, lo, hi in zip(plain, range(len(plain)), ends[offsets[:-1]], ends[offsets[1:]]):
            out[i] = np.concatenate((firsts[k], flat[lo:hi]))
        return out

    def _words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of " word" for each word, one after the other, and where each word's begin and how many they are."""
        whole = pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary)
        ids = np.array(self.fast.encode_ordinary(" " + pc.binary_join(whole, " ")[0].as_py()), np.uint32)
        ends = np.cumsum(self.width[ids])
        starts_of = np.cumsum(pc.binary_length(vocabulary).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(ends, starts_of)
        if not np.array_equal(ends[last], starts_of):
            raise ValueError("a token crosses a word border")
        begin = np.concatenate(([0], last[:-1] + 1))
        return ids, begin, last + 1 - begin


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(paths: tuple[str, str, str]) -> Encoder:
    """One encoder for each worker process."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document: the first may be shorter, the others are full."""
    first = n - (-(-n // limit) - 1) * limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def token_pieces(docs: DataFrame, row: str, text: str, paths: tuple[str, str, str], limit: int) -> DataFrame:
    """Pieces of every text: its ids and an id 0, cut to at most ``limit``."""

    def run(batches):
        for whole in batches:
            for batch in _batches(whole):
                out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for key, ids in zip(batch.column(0).to_pylist(), encoder(paths).encode(batch.column(1))):
                    raw = np.append(ids, np.uint32(0)).astype("<u4").tobytes()
                    for k, (start, length) in enumerate(cut(len(raw) // 4, limit)):
                        for name, value in zip(out, (key, k, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]))):
                            out[name].append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return docs.select(F.col(row).alias("row"), text_of(text).alias("text")).mapInArrow(run, PIECES)


def pack_group(lengths: np.ndarray, caps: tuple[float, float, float], weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each piece, longest first: among the bins with room in all
    capacities the one of the best score takes it, else a new bin opens.

    ``norm`` takes the least weighted norm of what would be left, ``dot`` the
    greatest weighted product of need and room. Ties go to the oldest bin.
    """
    caps_, w = np.array(caps, float), np.array(weights, float)
    n = len(lengths)
    bins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    need = np.stack([lengths.astype(float), np.ones(n), lengths.astype(float) ** 2], 1) / caps_
    if n and (need > 1 + 1e-12).any():
        raise ValueError("a piece is larger than an empty bin")
    room, ids, used = np.empty((64, 3)), np.empty(64, np.int64), np.empty(64, np.int64)
    open_, made, smallest = 0, 0, need.min(0) if n else None
    for i in range(n):
        v, best = need[i], -1
        if open_:
            left = room[:open_] - v
            fits = np.flatnonzero((left > -1e-12).all(1))
            if len(fits):
                gain = -((left[fits] ** 2) @ w) if score == "norm" else room[fits] @ (v * w)
                best = fits[np.argmax(gain)]
        if best < 0:
            if open_ == len(room):
                room, ids, used = np.resize(room, (2 * open_, 3)), np.resize(ids, 2 * open_), np.resize(used, 2 * open_)
            room[open_], ids[open_], used[open_] = 1.0, made, 0
            best, open_, made = open_, open_ + 1, made + 1
        bins[i], places[i] = ids[best], used[best]
        room[best] -= v
        used[best] += int(lengths[i])
        if (room[best] < smallest - 1e-12).any():  # nothing fits any more: close it, keep the order of the others
            room[best:open_ - 1], ids[best:open_ - 1], used[best:open_ - 1] = room[best + 1:open_].copy(), ids[best + 1:open_].copy(), used[best + 1:open_].copy()
            open_ -= 1
    return bins, places


def pack(
    docs: DataFrame,
    paths: tuple[str, str, str],
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 2048,
    max_docs: int = 2048,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001),
    score: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pack whole documents, cutting only those longer than ``limit``, into sequences.

    Pieces are staged, counted and dealt to groups of ``group_pieces`` on
    average, each packed by one task, however long or often repeated documents are.

    A sequence holds at most ``limit`` tokens, ``max_docs`` pieces and
    ``max_attention`` (by default ``limit`` squared) of summed squared lengths;
    the bin is chosen by ``score`` over all three, as :func:`pack_group` says.
    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A
    null or empty text is its end id alone; repeated rows are packed as often as
    they come, also with a null id; an empty table gives no row; other columns
    are left out, whatever they are called.
    """
    attention = float(limit) ** 2 if max_attention is None else float(max_attention)
    caps = (float(limit), float(max_docs), attention)
    pieces = stage(token_pieces(docs.select(doc_id, text), doc_id, text, paths, limit), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # pieces are dealt by content; those repeated so often that they would fill a group are dealt by row as well
    alike = ("row", "piece", "ids_crc32")
    repeated = pieces.groupBy(*[F.col(c).alias(f"_{c}") for c in alike]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_pieces // 2)
    marked = join_small(number_rows(pieces, "at"), stage(repeated, "repeated"), [(c, f"_{c}") for c in alike])
    salt = F.when(F.col("n").isNotNull(), F.col("at"))
    dealt = marked.select(*pieces.columns, F.pmod(F.xxhash64(*alike, salt), F.lit(groups)).alias("group"))

    def run(table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("row", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys))
        bins, places = pack_group(table["length"].to_numpy(), caps, weights, score)
        numbers = (table["group"].to_numpy().astype(np.int64) << 32) + bins
        table = table.drop_columns(["group"])
        return table.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(places))

    packed = dealt.groupBy("group").applyInArrow(run, PIECES + ", sequence_id long, offset long")
    return packed.withColumnRenamed("row", doc_id)
