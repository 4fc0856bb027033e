"""Planted passages in op3's operator, and the pipeline stage by stage, on small tables."""

from __future__ import annotations

import collections
import random
import re
import zlib

import corpus_pipeline
from conftest import SF_DIR
from scopeledger.llm import suffixes, urls
from scopeledger.llm.common import stage
from scopeledger.llm.queries import op3_repeated_strings

BLANK = re.compile(r"[\x20\x09-\x0D]")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_passages_are_removed_from_400_bytes_on(spark, tmp_path):
    """A passage of 51 to 100 words goes if it has 400 bytes, and stays if it has fewer, over many files and tasks."""
    rng = random.Random(6)
    passages = [prose(rng, n) for n in range(51, 101)]
    holders = collections.defaultdict(list)
    for k, passage in enumerate(passages):
        for _ in range(3):
            holders[rng.randrange(400)].append((k, passage))
    texts = []
    for i in range(400):
        parts = [prose(rng, rng.randint(5, 200))]
        for _, passage in holders[i]:
            parts += [passage, prose(rng, rng.randint(5, 60))]
        texts.append("\n".join(parts))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r for r in suffixes.repeated_spans(spark.read.parquet(f"{tmp_path}/docs"), size=400).collect()}
    long_ = {k for k, p in enumerate(passages) if len(p) >= 400}
    assert 10 < len(long_) < 45
    for i, text in enumerate(texts):
        removed = [text[s.a:s.b] for s in got[i].spans]
        mine = {k for k, _ in holders[i]}
        # a string may reach over the passage by what the texts around happen to share
        assert all(any(passages[k] in r for r in removed) for k in mine & long_), i
        assert len(removed) == sum(k in long_ for k, _ in holders[i]), i
        assert sum(map(len, removed)) <= sum(len(p) + 20 for k, p in holders[i] if k in long_), i


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_every_stage_of_the_pipeline_takes_effect(spark, tmp_path):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, "too short", "en", "src0"), (101, None, "en", "src1"), (102, "again and again " * 60, "en", "src2")]
    rows += [(200 + i, texts[i].replace(" ", "  "), "en", "src1") for i in range(8)]
    rows += [(300 + i, texts[i] + " one more end", "de", "src2") for i in range(8, 14)]
    rows += [(400, prose(rng, 9000), "en", "src2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    now, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        now = stage(step(spark, now, str(tmp_path)), f"test-{i}")
        out.append(now.collect())
    good, single, apart, mixed, packed = out
    assert {r.doc_id for r in good} == {r[0] for r in rows} - {100, 101, 102}
    groups = collections.defaultdict(list)
    for r in good:
        groups[BLANK.sub("", r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in single} == {min(g)[1] for g in groups.values()} and {r.doc_id for r in single} >= {200 + i for i in range(8)}
    kept = {r.doc_id for r in apart}
    assert kept == {r.doc_id for r in single} - {300 + i for i in range(8, 14)}
    for a in apart:
        for b in apart:
            if a.doc_id < b.doc_id:
                x, y = shingled(a.text), shingled(b.text)
                assert len(x & y) < 0.8 * len(x | y)
    for rows_ in (good, single, apart, mixed):
        assert rows_[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in mixed} <= kept and max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    sizes = collections.defaultdict(int)
    for r in apart:
        sizes[r.source] += len(r.text.split())
    taken = collections.defaultdict(int)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    # src0 weighs 5 of 8 and is capped at three times its size
    assert abs(taken["src0"] - 3 * sizes["src0"]) <= 1 and sum(taken.values()) <= sum(sizes.values()) * 1.01
    pieces = collections.Counter((r.doc_id, r.piece) for r in packed)
    copies = collections.Counter(r.doc_id for r in mixed)
    assert all(n == copies[doc] for (doc, _), n in pieces.items()) and {d for d, _ in pieces} == set(copies)
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in again) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_aliases_named_relative_to_the_page(spark):
    page = "https://a.org/x/y/z.html?q=1#f"
    cases = {
        "//b.com/de/p": "https://b.com/de/p", "/r/s": "https://a.org/r/s", "w.html": "https://a.org/x/y/w.html", "../w?k=2": "https://a.org/x/w?k=2",
        "./": "https://a.org/x/y/", "../../../../w/./v/": "https://a.org/w/v/", "?k=3": "https://a.org/x/y/z.html?k=3", "http://c.de/../p": "http://c.de/../p",
        "#top": None, "mailto:x@y.z": None, "": None,
    }
    rows = spark.createDataFrame([(t, page) for t in cases], "t string, u string")
    assert {r.t: r.v for r in rows.select("t", urls.resolved(rows.t, rows.u).alias("v")).collect()} == cases
    bare = spark.createDataFrame([("w", "http://a.org"), ("w", "no scheme"), ("w", None), (None, page)], "t string, u string")
    assert {r.v for r in bare.select(urls.canonical(urls.resolved(bare.t, bare.u)).alias("v")).collect()} == {"https://a.org/w", None}
    link = '<html><head><link rel="canonical" href="{}"></head>'
    pages = [(1, "http://a.net/q/one.html", link.format("//b.com/de/p")), (2, "http://b.com/de/x/y", link.format("../z")), (3, "http://b.com/fr/z", None),
             (4, "http://c.net/k/", link.format("../../m/n")), (5, "http://c.net/m/n", "x" * 200_000 + link.format("https://b.com/de/end"))]
    frame = stage(spark.createDataFrame([(*p, "v", "h") for p in pages], "page_id long, url string, html string, verdict string, host string"), "relative")
    rules = spark.createDataFrame([("com", "/de/", "block"), ("com", "/fr/", "allow")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(frame, rules).collect()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"}


def test_a_document_without_id_is_not_held_out(spark, tmp_path):
    from scopeledger.llm.queries import op5_toxicity

    rng = random.Random(8)
    rows = [(i, prose(rng, 30) + (" vile hateful scum" * 3 if i % 3 == 0 else "")) for i in range(60)] + [(None, "vile hateful scum"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_the_near_dedup_stage_links_by_simhash_and_by_shingles(spark, tmp_path):
    """Fingerprints within two bits are linked where shingles are not alike, through copies of equal shingles and chains of both."""
    from scopeledger.llm import simhash, similar

    rng = random.Random(9)
    base = prose(rng, 13).split()
    # the repeated part decides the fingerprint; the ends differ, so the shingle sets are less than 0.8 alike
    common = " ".join(base * 60)
    texts = {1: common + " " + prose(rng, 4), 2: common + " " + prose(rng, 4), 3: prose(rng, 150)}
    fps = {k: simhash.fingerprint(t.encode()) for k, t in texts.items()}
    assert (fps[1] ^ fps[2]).bit_count() <= 2 < (fps[1] ^ fps[3]).bit_count()
    x, y = shingled(texts[1]), shingled(texts[2])
    assert len(x & y) < 0.8 * len(x | y)
    texts[4] = texts[2].replace(" ", "  ")  # the shingles of 2
    texts[5] = texts[3] + " one more end"
    x, y = shingled(texts[3]), shingled(texts[5])
    assert 0.8 * len(x | y) <= len(x & y)
    frame = stage(spark.createDataFrame([(k, t) for k, t in sorted(texts.items())], "doc_id long, text string"), "both")
    assert {r.doc_id for r in similar.drop_similar(frame).collect()} == {1, 2, 3}
    step = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    left = step(spark, frame, str(tmp_path))
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {1, 3}
    assert step(spark, stage(frame.limit(0), "none"), str(tmp_path)).count() == 0


def test_benchmark_passages_over_50_words_have_fewer_than_400_bytes(spark, tmp_path):
    """Such a passage alone stays, however many documents hold it; two of them in a row reach 400 bytes and go."""
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").collect()]
    items = [t for t in items if len(t.split()) > 50]
    assert len(items) >= 10 and max(len(t.encode()) for t in items) < 400
    rng = random.Random(10)
    pairs = [" ".join(items[i:i + 2]) for i in range(0, 10, 2)]
    held = [(0, t) for t in items for _ in range(3)] + [(len(t.encode()), t) for t in pairs for _ in range(3)]
    texts = [f"{prose(rng, 30)}\n{t}\n{prose(rng, 30)}" for _, t in held]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_repeated_strings(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, (least, _) in enumerate(held):
        # the texts around may share a few bytes with the passage's ends
        assert got[i].n_spans == (least > 0) and least <= got[i].n_removed <= least + 10 * (least > 0), i
        assert got[i].n_bytes == len(texts[i].encode())


def test_shorter_passages_stay_for_their_size_alone(spark, tmp_path):
    """Passages of 51 words or more and 395 to 404 bytes, between different bytes: at 400 those below stay, at 250 all go."""
    rng = random.Random(11)
    passages = []
    for n in range(395, 405):
        passage = prose(rng, 51)
        while len(passage) < n:
            passage += " " + prose(rng, 1)
        passages += [passage[:n - 1] + "z"] * 3
    texts = [f"{prose(rng, 40)}{'XYZ'[i % 3]}{t}{'PQR'[i % 3]}{prose(rng, 40)}" for i, t in enumerate(passages)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for size in (400, 250):
        got = {r.doc_id: [texts[r.doc_id][s.a:s.b] for s in r.spans] for r in suffixes.repeated_spans(docs, size=size).collect()}
        assert got == {i: [t] if len(t) >= size else [] for i, t in enumerate(passages)}
