"""Operators choose the same rows on both sides of a size switch, and hold no more than they say."""

import collections
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from scopeledger.llm import mixing, packing, suffixes, warc
from scopeledger.llm.common import stage
from scopeledger.llm.queries import tokenizer_paths


def drawn_by_rounds(rows, goal):
    """Rows ``(h, row, size)`` taken round by round, written out plainly."""
    taken, left, cap = [], goal, goal
    rows = sorted(r for r in rows if r[2] <= goal)
    while rows:
        total, now = 0, []
        for r in rows:
            if r[2] > cap:
                continue
            if total + r[2] > left:
                break
            total += r[2]
            now.append(r)
        taken += now
        left -= total
        rows = [r for r in rows if r not in now and 0 < r[2] <= left]
        if rows:
            cap = left / 2 if min(r[2] for r in rows) <= left / 2 else left
    return taken


def copies_of(rows, target, size):
    """Copies of each row of one source, as :func:`mixing.sample_epochs` states them."""
    whole = int(target / size + 1e-6) if size else 0
    rest = target - whole * size
    copies = {r[1]: whole for r in rows}
    if rest < 0.5:
        return copies
    drawn = drawn_by_rounds(rows, rest)
    left = rest - sum(r[2] for r in drawn)
    others = [r for r in rows if r[2] > 0 and r not in drawn]
    extra = set(drawn)
    if others:
        pick = min(others, key=lambda r: (r[2], r[0], r[1]))
        over = pick[2] - left
        gone = []
        if over > mixing.NEAR * rest and left > mixing.NEAR * rest:
            gone = drawn_by_rounds([((1 << 63) - 1 - h, row, n) for h, row, n in drawn if n > 0], over)
        if over - sum(r[2] for r in gone) < left:
            extra = {r for r in drawn if r[1] not in {g[1] for g in gone}} | {pick}
    for r in extra:
        copies[r[1]] += 1
    return copies


@pytest.mark.parametrize("small", [0, 10, 4096])
def test_mix_draws_the_same_rows_by_every_path(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "SMALL", small)
    rng = random.Random(11)
    rows, expected = [], {}
    for s in range(6):
        own = [(rng.getrandbits(62), len(rows) + i, rng.choice([0, 1, 7, 60, rng.randint(1, 900), 5000 * (i % 29 == 0)])) for i in range(150)]
        size = sum(n for _, _, n in own)
        target = float(rng.randint(1, 3 * size)) if s else 3.0 * size
        rows += [(row, None if s == 5 else f"s{s}", n, size, target, h) for h, row, n in own]
        expected |= copies_of(own, target, size)
    frame = stage(spark.createDataFrame(rows, "_row long, src string, n long, source_size long, target double, o long"), "rounds")
    got = {r["_row"]: r["copies"] for r in mixing.sample_epochs(frame, "_row", "src", "n", "o").collect()}
    assert got == expected


def test_weights_go_by_code_point(spark):
    names = ["b", None, "a", "\U0001f600", "￮", "B"]
    got = mixing.cyclic_weights(spark.createDataFrame([(n, 1) for n in names], "s string, n long"), "s", (5, 2, 1)).collect()
    assert {r.s: r.weight for r in got} == {"B": 5, "a": 2, "b": 1, "￮": 5, "\U0001f600": 2, None: 1}


def plain_runs(group, half, size):
    found = []
    for i, (before, behind) in enumerate(group):
        offsets = []
        for r in range(max(size - half - len(behind), 0), len(before) + 1):
            window = (before[len(before) - r:], behind[:size - half - r])
            alike = 0
            for j, (b, e) in enumerate(group):
                fits = r <= len(b) and size - half - r <= len(e)
                alike += j != i and fits and (b[len(b) - r:], e[:size - half - r]) == window
            if alike:
                offsets.append(r)
        runs = []
        for r in offsets:
            if runs and runs[-1][1] == r - 1:
                runs[-1][1] = r
            else:
                runs.append([r, r])
        found.append(runs)
    return found


def test_windows_of_one_rank_are_compared_exactly():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randint(2, 12)
        half = size // 2
        group = []
        for _ in range(rng.randint(1, 8)):
            before = bytes(rng.choices(b"ab", k=rng.randint(0, size - half)))
            least = max(size - half - len(before), 0)
            group.append((before, bytes(rng.choices(b"ab", k=rng.randint(least, size - half)))))
        assert suffixes.repeated_runs(group, half, size) == plain_runs(group, half, size)


def test_windows_of_one_rank_need_memory_for_their_members_alone():
    rng = random.Random(6)
    group = [(rng.randbytes(200), rng.randbytes(200)) for _ in range(2000)]
    tracemalloc.start()
    assert suffixes.repeated_runs(group, 200, 400) == [[]] * 2000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20  # one window of 200 bytes each; all windows at once would take 80 MB and more


def test_packing_groups_are_cut_by_pieces(spark):
    rows = [(1, "word " * 9000), (2, "other " * 9000)] + [(None, "same text")] * 300
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string"), "pieces-test")
    got = packing.pack(docs, tokenizer_paths(), limit=128, group_pieces=32).toPandas()
    sizes = collections.Counter(got.sequence_id.to_numpy() >> 32)
    assert len(got) > 400 and max(sizes.values()) <= 64
    assert got[got.doc_id.isna()].shape[0] == 300 and (got.groupby("sequence_id").length.sum() <= 128).all()
    at = got.sort_values(["sequence_id", "offset"])
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all()


def test_a_revisit_without_a_scheme_meets_the_same_uri(spark):
    rows = [
        (1, "h.com/a", 10, "response", 200), (2, "h.com/a", 20, "revisit", 304), (3, "h.com/A", 20, "revisit", 304), (4, "", 5, "response", 200),
        (5, "", 20, "revisit", 304), (6, "http://h.com/a", 20, "revisit", 304), (7, "urn:x", 9, "revisit", 304),
    ]
    frame = spark.createDataFrame(rows, "record_id long, uri string, ts long, kind string, status int").withColumn("ts", F.timestamp_seconds("ts"))
    frame = frame.withColumn("payload_digest", F.lit(None).cast("string")).withColumn("headers", F.lit(None).cast("map<string,string>"))
    got = {r.record_id: (r.response_id, r.outcome) for r in warc.resolve_revisits(frame).collect()}
    lost = (None, "no_response")
    assert got == {2: (1, "resolved"), 3: lost, 5: (4, "resolved"), 6: lost, 7: lost}
