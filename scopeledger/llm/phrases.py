"""Collocated phrases by vertical partitioning of a depth-truncated suffix tree over words.

Word prefixes that begin more suffixes than a memory budget are lengthened by
a word until each begins at most that many; below a pair that is still too
much, every longer phrase is a prefix of its own. The prefixes are dealt to
groups that hold about the budget, every suffix goes to the group of its
prefix, and each group builds its part of the tree on its own, from suffixes
cut at five words, where the total of the leaves below a node is the count of
its phrase.

A suffix also ends before the first word, and the first pair of words, that is
too rare, since no phrase that holds it can be frequent enough: the tree is
built to a depth of two first, then below the pairs that are left. Tasks know
rare words and pairs from bitmaps of fixed size, which let some pass; the
counts of the tree are exact, so those go at the end.
"""

from __future__ import annotations

import collections
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scopeledger.llm import filters
from scopeledger.llm.common import fresh, join_small, ship, stage, text_of

ship(__name__)

DEPTH = 5
#: Suffixes a group of prefixes may hold.
BUDGET = 1 << 20
#: Words a task codes and sorts at once; under 2 ** 21, as three of their numbers share a sort key.
CHUNK = 2_000_000
#: Of packed numbers of words, the last.
LOW = (1 << 21) - 1
#: Bytes of a text that are split into words at once.
SEGMENT = 1 << 20
#: Stands for the end of a piece; no UTF-8 text has this byte.
BREAK = b"\xff"
LETTERS = bytes(
    255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def words(text: bytes):
    """Words and ends of pieces as ``tokens, own``: lists of limited length that overlap by ``DEPTH - 1`` tokens after ``own``."""
    text = text.translate(LETTERS).replace(BREAK, b" \xff ")
    at, carried = 0, []
    while True:
        end = text.find(b" ", at + SEGMENT) if len(text) - at > SEGMENT else -1
        tokens = carried + (text[at:end] if end >= 0 else text[at:]).split()
        if end < 0:
            yield tokens, len(tokens)
            return
        own = max(len(tokens) - DEPTH + 1, 0)
        yield tokens[:], own
        carried, at = tokens[own:], end


def chunks(batches):
    """``lang, words, ids, own`` of about ``CHUNK`` tokens: the different words, the text as their numbers (0 ends a piece), and
    which numbers are no overlap."""
    held, size = {}, 0

    def coded():
        for lang, (number, ids, own) in held.items():
            yield lang, list(number), np.concatenate(ids).astype(np.int64), np.concatenate(own)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in held:
                held[lang] = collections.defaultdict(itertools.count().__next__), [], []
                held[lang][0][BREAK]
            number, ids, own = held[lang]
            for tokens, n in words(text.as_py()):
                tokens.append(BREAK)
                ids.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
                own.append(np.arange(len(tokens)) < n)
                size += n
            if size >= CHUNK - SEGMENT // 2:
                yield from coded()
                held, size = {}, 0
    if size:
        yield from coded()


def _rows(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names)


def _count_words(batches):
    """Counts of words, and of all words as those of a null phrase."""
    for lang, found, ids, own in chunks(batches):
        counts = np.bincount(ids[own], minlength=len(found))
        counts[0] = 0
        some = np.flatnonzero(counts)
        yield _rows(["lang", "phrase", "f"], [
            pa.array([lang] * (len(some) + 1), pa.string()), pa.array([*[found[i] for i in some.tolist()], None], pa.binary()),
            pa.array(np.append(counts[some], counts.sum()))])


def suffixes(ids: np.ndarray, own: np.ndarray, common: np.ndarray, frequent_pair=None) -> tuple[np.ndarray, np.ndarray]:
    """Different suffixes as sorted rows of numbers (0 after the end), and their counts.

    Without ``frequent_pair`` a suffix is a pair of common words. With it, it has
    three words at least and ends at ``DEPTH`` words, before a rare word and
    before a word that makes a rare pair.
    """
    n = len(own)
    ids = np.concatenate((np.where(common[ids], ids, 0), np.zeros(DEPTH, np.int64)))
    linked = np.zeros(n + DEPTH, bool)
    linked[:-1] = (ids[:-1] > 0) & (ids[1:] > 0)
    if frequent_pair is None:
        rows = np.flatnonzero(own & linked[:n])
        pairs, counts = np.unique(ids[rows] << 21 | ids[rows + 1], return_counts=True)
        return np.column_stack((pairs >> 21, pairs & LOW)), counts
    where = np.flatnonzero(linked)
    pairs, which = np.unique(ids[where] << 21 | ids[where + 1], return_inverse=True)
    linked[where] = frequent_pair(pairs)[which]
    rows = np.flatnonzero(own & linked[:n] & linked[1:n + 1])
    first = ids[rows] << 42 | ids[rows + 1] << 21 | ids[rows + 2]
    fourth = np.where(linked[rows + 2], ids[rows + 3], 0)
    fifth = np.where(linked[rows + 2] & linked[rows + 3], ids[rows + 4], 0)
    order = np.argsort(first)
    new = _changes(first[order])
    rest, counts = np.unique((np.cumsum(new) - 1) << 42 | fourth[order] << 21 | fifth[order], return_counts=True)
    first = first[order][new][rest >> 42]
    return np.column_stack((first >> 42, first >> 21 & LOW, first & LOW, rest >> 21 & LOW, rest & LOW)), counts


def _changes(values: np.ndarray) -> np.ndarray:
    """Which values (or rows of them) differ from the one before."""
    new = np.ones(len(values), bool)
    if len(values):
        other = values[1:] != values[:-1]
        new[1:] = other if values.ndim == 1 else other.any(1)
    return new


def lengthened(table: np.ndarray, counts: np.ndarray, heavy: np.ndarray, heavy_pair=None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the suffixes, with their counts and how many words make each one's prefix: the shortest that is not heavy.

    Which phrases beyond pairs are heavy is not known: suffixes below a heavy
    pair come once as each longer phrase, all of whose words make the prefix.
    """
    level = 1 + heavy[table[:, 0]]
    if heavy_pair is None:
        return [(table, counts, level)]
    open_ = np.flatnonzero(level > 1)
    pairs, which = np.unique(table[open_, 0] << 21 | table[open_, 1], return_inverse=True)
    level[open_] += heavy_pair(pairs)[which]
    parts, below = [(table[level < 3], counts[level < 3], level[level < 3])], level == 3
    table, counts = table[below], counts[below]
    for depth in range(3, DEPTH + 1):
        counts, table = counts[table[:, depth - 1] > 0], table[table[:, depth - 1] > 0]
        if not len(table):
            break
        starts = np.flatnonzero(_changes(table[:, :depth]))
        phrases = table[starts]
        phrases[:, depth:] = 0
        parts.append((phrases, np.add.reduceat(counts, starts), np.full(len(starts), depth)))
    return parts


def _deal(common: bytes, heavy: bytes, pairs: bytes | None, heavy_pairs: bytes | None, groups: int):
    """Suffixes by group of their prefix: pairs of common words, or all that go on below the frequent pairs."""
    def run(batches):
        for lang, found, ids, own in chunks(batches):
            seed = filters.seed_of(lang)
            digests = filters.digests(found, seed)

            def among(bits):
                return lambda coded: filters.held(bits, filters.digests(  # noqa: B023
                    [found[a] + b" " + found[b] for a, b in zip((coded >> 21).tolist(), (coded & LOW).tolist())], seed))  # noqa: B023

            usual = filters.held(common, digests)
            usual[0] = False
            table, counts = suffixes(ids, own, usual, None if pairs is None else among(pairs))
            if len(table):
                parts = lengthened(table, counts, filters.held(heavy, digests), None if pairs is None else among(heavy_pairs))
                yield messages(lang, found, digests, groups, *[np.concatenate(x) for x in zip(*parts)])

    return run


MESSAGE = "lang string, group long, names binary, codes binary, tallies binary"


def messages(
    lang: str, found: list[bytes], digests: np.ndarray, groups: int, table: np.ndarray, counts: np.ndarray, level: np.ndarray
) -> pa.RecordBatch:
    """A row for each group: its words, its suffixes as numbers of those words from 1, and their counts and prefix lengths.

    All groups are written at once, so that the cost follows the suffixes and not the number of groups, which grows with the input.
    """
    mixed = np.zeros(len(table), np.uint64)
    for k in range(table.shape[1]):
        mixed = np.where(k < level, (mixed ^ digests[table[:, k]]) * np.uint64(0x9E3779B97F4A7C15), mixed)
        mixed ^= mixed >> np.uint64(32)
    group = (mixed % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group)
    group, table = group[order], table[order]
    new = _changes(group)
    starts, message = np.flatnonzero(new), np.cumsum(new) - 1
    used = table > 0
    cells, which = np.unique((message[:, None] << 21 | table)[used], return_inverse=True)
    firsts = np.searchsorted(cells, np.arange(len(starts) + 1) << 21)
    codes = np.zeros(table.shape, np.int64)
    codes[used] = which - np.broadcast_to(firsts[message][:, None], table.shape)[used] + 1
    words_of = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(found, pa.binary()).take(pa.array(cells & LOW)))
    ends = np.append(starts, len(table))
    return _rows(["lang", "group", "names", "codes", "tallies"], [
        pa.array([lang] * len(starts), pa.string()), pa.array(group[starts]), pc.binary_join(words_of, b" "),
        _slices(codes.astype("<u2" if codes.max() < 1 << 16 else "<u4"), ends), _slices((counts[order] << 3 | level[order]).astype("<u4"), ends)])


def _slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of the rows between each two ends."""
    offsets = pa.array(ends * (values.nbytes // len(values)), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def leaves(table: pa.Table, depth: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, suffixes as its numbers from 1 (0 after the end), tallies, and the row of ``table`` that each is from."""
    lists = pc.split_pattern(table.column("names").combine_chunks(), b" ")
    coded = lists.flatten().dictionary_encode()
    number, firsts = coded.indices.to_numpy() + 1, lists.offsets.to_numpy()[:-1]
    sizes = pc.binary_length(table.column("tallies")).to_numpy().astype(np.int64) // 4
    width = pc.binary_length(table.column("codes")).to_numpy() // (sizes * depth)
    parts = []
    for kind in (2, 4):
        some = np.flatnonzero(width == kind)
        if len(some):
            part = table.take(pa.array(some))
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), f"<u{kind}").reshape(-1, depth).astype(np.int64)
            row = np.repeat(some, sizes[some])
            parts.append((
                np.where(codes > 0, number[np.maximum(codes - 1 + firsts[row][:, None], 0)], 0),
                np.frombuffer(b"".join(part.column("tallies").to_pylist()), "<u4").astype(np.int64), row))
    return coded.dictionary, *[np.concatenate(x) for x in zip(*parts)]


def _subtree(least: int, shortest: int, longest: int):
    """Counts of a group's phrases of ``shortest`` to ``longest`` words: the totals of the leaves below each node, level by level."""
    def run(table: pa.Table) -> pa.Table:
        langs = table.column("lang").combine_chunks().dictionary_encode()
        vocabulary, numbers, tallies, row = leaves(table, longest)
        node, counts, level = langs.indices.to_numpy().astype(np.int64)[row], tallies >> 3, tallies & 7
        base, nodes, out = len(vocabulary) + 1, [], [[], [], []]
        for depth in range(1, longest + 1):
            going = numbers[:, depth - 1] > 0
            node, numbers, counts, level = node[going], numbers[going], counts[going], level[going]
            found, node = np.unique(node * base + numbers[:, depth - 1], return_inverse=True)
            nodes.append((found // base, found % base))
            if depth < shortest or not len(found):
                continue
            # a node above its suffixes' prefix has leaves in other groups; it is counted with a shorter prefix or as a phrase of its own
            totals = np.bincount(node, np.where(level <= depth, counts, 0)).astype(np.int64)
            up = kept = np.flatnonzero(totals >= least)
            path = []
            for above, word in reversed(nodes):
                path.append(word[up] - 1)
                up = above[up]
            spelled = [vocabulary.take(pa.array(p)).to_pylist() for p in reversed(path)]
            out[0] += langs.dictionary.take(pa.array(up)).to_pylist()
            out[1] += map(b" ".join, zip(*spelled))
            out[2] += totals[kept].tolist()
        return pa.table({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.binary()), "f": pa.array(out[2], pa.int64())})

    return run


COUNTS = "lang string, phrase binary, f long"


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of every phrase of one to five words with ``f`` of ``least`` or more, and ``lang, n`` of all words.

    Phrases are words joined by blanks, as bytes. Both tables are staged. The
    texts are read three times at every size: for words, pairs and longer phrases.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))

    def weighed(counts):
        """Bitmaps of all phrases and of the heavy ones, and how many suffixes they begin, those below heavy ones once for each length."""
        total, twice = counts.agg(F.sum("f"), F.sum(F.when(F.col("f") > budget, 2 * F.col("f")))).first()
        bits = [filters.bitmap_of(c, F.col("lang"), F.col("phrase")) for c in (counts, counts.where(F.col("f") > budget))]
        return *bits, 1 + 2 * ((total or 0) + (twice or 0)) // budget

    def tree(run, shortest, longest):
        dealt = texts.mapInArrow(run, MESSAGE)
        return stage(dealt.groupBy("group").applyInArrow(_subtree(least, shortest, longest), COUNTS), f"phrases-{longest}")

    found = stage(texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(
        F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    sizes = found.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    singles = found.where(F.col("phrase").isNotNull())
    common, heavy, groups = weighed(singles)
    # pairs come first, as they end most suffixes; then all that is left
    pairs = tree(_deal(common, heavy, None, None, groups), 2, 2)
    usual, heavy_pairs, groups = weighed(pairs)
    longer = tree(_deal(common, heavy, usual, heavy_pairs, groups), 3, DEPTH)
    return singles.unionByName(pairs).unionByName(longer), sizes


def _part(start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, top: int = 2000, budget: int = BUDGET
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (ASCII capitals in lower case) are split at ``. , ; : ! ?`` and line
    ends into pieces, pieces at blanks and tabs into words; phrases of two to
    five words lie within a piece, overlapping occurrences count. Of a phrase's
    cuts in two the one of least ``1000 a n / (l r)``, rounded down, counts,
    then the earliest; phrases inside a longer one that is just as frequent go.
    Order: score, then ``a``, both falling, then the phrase's bytes. A null
    language is ``und``; null and empty texts have no words; repeated rows count
    each; other columns are ignored; no words give no row. ``budget`` is how
    many suffixes a group may hold: memory of a task, not results.
    """
    counts, sizes = phrase_counts(docs, lang, text, least, budget)
    counted = counts.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")
    split = counted.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words"))
    long_ = split.where("k >= 2")
    inner = long_.where("k >= 3").select(
        "lang", F.explode(F.array(_part(1, F.col("k") - 1), _part(2, F.col("k") - 1))).alias("phrase"), F.col("f").alias("a"))
    kept = long_.withColumnRenamed("f", "a").join(inner, ["lang", "phrase", "a"], "left_anti")
    cut = kept.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    (other,) = fresh(both, "other")
    sized = join_small(both, sizes.withColumnRenamed("lang", other), [("lang", other)], "inner")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    top_part = (F.lit(1000).cast("decimal(4,0)") * exact("a")) * exact("n")
    sized = sized.withColumns({"_top": top_part, "_low": exact("l") * exact("r")}).withColumn("score", F.expr("_top div _low"))
    best = sized.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
