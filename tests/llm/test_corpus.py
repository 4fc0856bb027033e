"""Corpus operators against brute-force versions on small fixtures with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scopeledger.llm import credentials, exact, mixing, packing, quality, simhash, similar, suffixes, toxicity, urls, warc
from scopeledger.llm.common import MIN_SPLITS, number_rows, stage
from scopeledger.llm import components as components_of  # the module
from scopeledger.llm.components import components
from scopeledger.llm.queries import tokenizer_paths

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = re.compile(r"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, text string, lang string, source string, _row long, best string, u string"


def awkward_texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = [" ".join(word() for _ in range(n)) for n in (3, 30, 60, 90, 150, 400)]
    passage = " ".join(word() for _ in range(120))
    long_ = " ".join(word() for _ in range(6000))
    return [
        None, "", " \t\n", "x", "one two", *prose, prose[4], prose[4].replace(" ", "  "), prose[5] + " tail", "A" + prose[5],
        prose[2] + "\n" + passage + "\n" + prose[1], passage + " " + prose[3], prose[0] + passage + prose[0], "ab " * 300, "a" * 900, long_,
        long_ + " end", "a line\nb\na line\na line\n \n\n", "UP!! " * 40, "x %%% &&& ### " * 20, "  lead and trail  ", "a\u00a0 b\u2003c \n d",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    texts = awkward_texts()
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], 7, "z", "y") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[7], "en", "s1", 7, "z", "y"), (None, "alone", None, None, None, None, None)]
    return stage(spark.createDataFrame(rows, SCHEMA).coalesce(3), "fixture")


@pytest.fixture(scope="module")
def empty(spark):
    return stage(spark.createDataFrame([], SCHEMA), "empty")


def text_rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_exact_groups(docs, empty):
    groups = collections.defaultdict(list)
    for i, t in text_rows(docs):
        groups[BLANK.sub("", t)].append((-len(t), i is None, i if i is not None else 0))
    got = exact.exact_groups(docs).collect()
    assert len(got) == docs.count()
    expected = collections.Counter()
    for members in groups.values():
        _, unknown, keep = min(members)
        for _, no_id, i in members:
            expected[(None if no_id else i, None if unknown else keep, len(members))] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert exact.drop_exact(docs).count() == len(groups) and exact.drop_exact(docs).columns == docs.columns
    assert exact.exact_groups(empty).count() == 0


def test_row_numbers_outlive_lost_executors(spark, tmp_path):
    parallelism = "spark.sql.leafNodeDefaultParallelism"  # what a scan asks for; by default it follows the live executors
    spark.range(0, 400_000, 1, 1).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text").write.parquet(f"{tmp_path}/t")
    spark.conf.unset(MIN_SPLITS)
    try:
        docs = spark.read.parquet(f"{tmp_path}/t")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set(parallelism, "8")
        at = lambda: {(r.doc_id, r._row) for r in number_rows(docs, "_row").where("doc_id % 1000 = 0").collect()}
        kept = exact.drop_exact(docs)
        before = at()
        spark.conf.set(parallelism, "2")
        assert at() == before and kept.count() == 400_000
    finally:
        for name in (parallelism, MIN_SPLITS, "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)


def test_equal_digests_of_different_contents(docs):
    weak = lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 3), 2, "0"))
    strong = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs, digest=weak).collect()} == strong


def windows_removed(texts: list[bytes], size: int):
    seen = collections.Counter(t[k:k + size] for t in texts for k in range(len(t) - size + 1))
    for t in texts:
        runs: list[list[int]] = []
        for k in range(len(t) - size + 1):
            if seen[t[k:k + size]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + size
                else:
                    runs.append([k, k + size])
        at, left = 0, b""
        for a, b in runs:
            left, at = left + t[at:a], b
        yield len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left + t[at:]).hexdigest()


@pytest.mark.parametrize(("size", "shared"), [(400, 20_000), (61, 20_000), (61, 3)])
def test_repeated_spans(docs, empty, size, shared):
    rows = text_rows(docs)
    expected = collections.Counter((i, *r) for (i, _), r in zip(rows, windows_removed([t.encode() for _, t in rows], size)))
    got = suffixes.repeated_spans(docs, size=size, shared=shared).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == expected
    if shared == 3:
        assert suffixes.repeated_spans(empty).count() == 0


def test_long_texts_are_ranked_in_parts_alike(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 40_000, dtype=np.uint8)
    whole = suffixes.anchors(data, np.array([0]), np.array([len(data)]), 100)
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([data.tobytes()], pa.binary())], ["_row", "t"])
    parts = [b for b in suffixes._rank_positions(100)(iter([batch]))]
    assert set(np.concatenate([b.column(2).to_numpy() for b in parts])) == set(whole[1])


def brute_fingerprint(text: str) -> int:
    words = text.encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_near_groups(docs, empty):
    rows = [(i, brute_fingerprint(t)) for i, t in text_rows(docs)]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                old, new = component[a], component[b]
                component = [new if c == old else c for c in component]
    least = {c: min((i for (i, _), k in zip(rows, component) if k == c and i is not None), default=None) for c in component}
    expected = collections.Counter((i, f, least[c]) for (i, f), c in zip(rows, component))
    got = simhash.near_groups(docs).collect()
    assert collections.Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in got) == expected
    assert sum(r.kept for r in got) == len(set(component)) == simhash.drop_near(docs).count()
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near(docs).columns == docs.columns


def brute_similar(rows, at_least=0.8):
    """Pairs of rows at or above a Jaccard similarity of five-word shingles, and how many rows stay."""
    sets = []
    for _, t in rows:
        words = t.encode().translate(simhash.LOWER).split()
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= at_least * len(sets[i] | sets[j]) - 1e-9]
    root = list(range(len(sets)))
    for i, j in pairs:
        old, new = root[i], root[j]
        root = [new if r == old else r for r in root]
    return pairs, len(set(root))


def test_near_copies_of_five_words_go(spark, docs, empty):
    """Copies with changed words, most of them far beyond two bits of the fingerprint, also in chains and in a large group."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        words = rng.choices(vocabulary, k=rng.randint(40, 160))
        for _ in range(4 if g else 40):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice((1, 1, 2, 3))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    pairs, stay = brute_similar(rows)
    frame = stage(spark.createDataFrame(rows, "doc_id long, text string"), "near-copies")
    fps = [brute_fingerprint(t) for _, t in rows]
    assert sum((fps[i] ^ fps[j]).bit_count() > 2 for i, j in pairs) > len(pairs) / 2
    assert stay < len(rows) / 2
    assert similar.drop_similar(frame).count() == stay
    assert similar.drop_similar(frame, sweep=6).count() == stay
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns and kept.count() == brute_similar(text_rows(docs))[1]
    assert similar.drop_similar(empty).count() == 0


def test_pipeline_drops_near_copies_at_the_stage(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[:60] + ["x"] + words[61:140] + ["y"] + words[141:]), "something else"]
    assert brute_similar(list(enumerate(texts)))[1] == 2
    frame = stage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near-stage")
    left = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, frame, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2]


@pytest.mark.parametrize("sweep", [4096, 4])
def test_links_of_fingerprints(spark, sweep):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:6]:
        for _ in range(40):
            fps.add(centre ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 5)))))
    fps = sorted(fps)
    group = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {f: new if g == old else g for f, g in group.items()}
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = components(simhash.links(frame, sweep=sweep), "a", "b").collect()
    classes = collections.defaultdict(set)
    for r in found:
        classes[r.component].add(r.node % (1 << 64))
    expected = collections.defaultdict(set)
    for f, g in group.items():
        expected[g].add(f)
    assert {frozenset(c) for c in classes.values()} == {frozenset(c) for c in expected.values() if len(c) > 1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (200, 199), (200, 199)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 160)} | {199: 199, 200: 199}


def brute_measures(text: str):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    counts = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if counts[tuple(words[k:k + 8])] > 1 for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rule(docs, empty, spark):
    labels = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.judge(quality.measure(docs), labels).collect()
    for r in got:
        expected = brute_measures(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.doc_id
        assert r.kept == (not r.base_failed) and r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
    assert len(got) == docs.count() and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(empty, labels).count() == 0


@pytest.mark.parametrize("rate", [0.005, 0.2])
def test_binomial_tail_is_exact(spark, rate):
    cases = [(k, n) for n in (1, 5, 17, 400, 3000) for k in (0, 1, 3, 15, 16, 40) if k < n * rate]
    frame = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), rate).alias("p"))
    for r in frame.collect():
        exact_ = math.fsum(math.comb(r.n, i) * rate ** i * (1 - rate) ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact_, rel=1e-9)
    big = spark.range(1).select(quality.binomial_tail(F.lit(4_990_000), F.lit(10 ** 9), 0.005).alias("p")).first().p
    assert 0 < big < 1e-3


def test_cutoffs_hold_their_risk(spark):
    rng = random.Random(2)
    rows = [("en", 1, min(1.0, rng.random() * 0.2), 0.0) for _ in range(4000)] + [("en", 0, 0.5 + rng.random(), 0.0) for _ in range(300)]
    rows += [("fr", 1, 0.0, 0.0)] * 50 + [("fr", 0, 1.0, 0.0)] * 50
    frame = spark.createDataFrame(rows, "lang string, good int, x double, y double")
    found = quality.cutoffs(frame, "lang", "good", {"x": ("x", (1.0, 0.5, 0.3, 0.1, 0.05)), "y": ("y", (0.5, 0.1))}, 0.01, 0.05).collect()
    assert [(r.stratum, r.rule, r.cutoff, r.false_rejected, r.bad_rejected) for r in found] == [("en", "x", 0.5, 0, 300)]
    assert found[0].p_value <= 0.05 / 4  # two strata, two rules; French has too few labels


def test_mix_reaches_targets(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 60), "x", f"s{min(i % 40, 5)}" if i % 7 else None) for i in range(3000)]
    frame = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "mix-test")
    got = mixing.mix_plan(frame, (5, 2, 1)).toPandas()
    source = {r[0]: r[3] for r in rows}
    got["source"] = got.doc_id.map(source).fillna("~")
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((sums.taken - sums.target).abs() <= 0.01 * sums.target + 1).all() and (got.taken <= 3 * got["size"]).all()
    assert sums.target.sum() == pytest.approx(got["size"].sum()) and (sums.target <= 3 * sums["size"] + 1e-6).all()
    again = mixing.mix_plan(frame, (5, 2, 1)).toPandas().sort_values("doc_id").taken.tolist()
    assert again == got.sort_values("doc_id").taken.tolist()
    assert mixing.mix_plan(docs, (5, 2, 1)).count() == docs.count() and mixing.mix_plan(empty, (5, 2, 1)).count() == 0
    split = stage(frame.repartition(7, "text"), "mix-split")  # other files and order, same rows
    assert mixing.mix_plan(split, (5, 2, 1)).toPandas().sort_values("doc_id").taken.tolist() == again
    mixed = mixing.mix(frame, (5, 2, 1))
    assert mixed.columns == frame.columns and mixed.count() == got.copies.sum()


@pytest.mark.parametrize(("giant", "target", "small"), [(60_000, 15_000, 4096), (60_000, 60_000, 4096), (60_000, 65_000, 0)])
def test_mix_passes_over_a_giant_document(spark, monkeypatch, giant, target, small):
    """One very long document among 400 short ones, in eight orders."""
    monkeypatch.setattr(mixing, "SMALL", small)
    rows = []
    for s in range(8):
        sizes = [50] * 400 + [giant]
        for i, n in enumerate(sizes):
            h = xxhash.xxh64_intdigest(f"{s} {i}") >> 1
            rows.append((len(rows), f"s{s}", n, 20_000 + giant, float(target), h))
    frame = stage(spark.createDataFrame(rows, "_row long, src string, n long, source_size long, target double, o long"), "giant")
    got = mixing.sample_epochs(frame, "_row", "src", "n", "o").toPandas()
    assert len(got) == len(rows) and got.copies.isin([0, 1]).all()
    assert ((got.n * got.copies).groupby(got.src).sum() == target).all()


def test_water_filling_is_the_exact_fixed_point(spark):
    sizes = [("a", 10, 5.0), ("b", 1000, 2.0), ("c", 30, 1.0), ("d", 0, 5.0), ("e", 50, 0.0)]
    got = {r.s: r.target for r in mixing.water_fill(spark.createDataFrame(sizes, "s string, n long, w double"), "n", "w", 3.0).collect()}
    assert got["a"] == 30 and got["c"] == 90 and got["d"] == 0 and got["e"] == 0 and got["b"] == pytest.approx(1090 - 120)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_paths()[0])
    expected = collections.Counter()
    for i, t in text_rows(docs):
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            expected[(i, k, start, n, zlib.crc32(ids[start:start + n].tobytes()))] += 1
    got = packing.pack(docs, tokenizer_paths()).toPandas()
    keys = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got.notna(), None)
    assert collections.Counter(tuple(None if x is None else int(x) for x in r) for r in keys.itertuples(index=False)) == expected
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(empty, tokenizer_paths()).count() == 0


def test_special_token_and_loose_blanks_match_the_tokenizer():
    e = packing.encoder(tokenizer_paths())
    texts = ["a <|endoftext|> b", "two  blanks", "end ", " lead", "x \n y", "", "it's we'll\n\nok", "a\x0b b \x85c", "ünï cödé 日本 語"]
    for text, ids in zip(texts, e.encode(pa.array(texts))):
        assert ids.tolist() == e.whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_bins_respect_every_capacity(score):
    lengths = np.sort(np.random.default_rng(1).integers(1, 90, 500))[::-1]
    bins, places = packing.pack_group(lengths, (100.0, 3.0, 8100.0), (1.0, 0.5, 0.5), score)
    for b in set(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own ** 2).sum() <= 8100
        assert sorted(places[bins == b]) == sorted(np.cumsum(own) - own)


def test_toxicity_learns_from_positives_and_unlabelled(spark, docs, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    vocabulary = [word() for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = rng.choices(vocabulary, k=60) + (rng.choices(["vilezz", "hatexx", "scumyy"], k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic)))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_texts(frame, frame.where("doc_id < 700"), known.where("doc_id < 700")).collect()}
    held = [i for i in got if i >= 700]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_texts(docs, docs, known.limit(0)).count() == docs.count()
    assert toxicity.score_texts(empty, empty, known.limit(0)).count() == 0


def test_secrets(spark, empty):
    live, common, key = "f3" * 10 + "0a1b2c3d4e5f6789", "0123456789abcdef" * 2, "AKIA" + "QWERTY1234567890"
    texts = [
        ("o1", f'é token = "{live}" x'), ("o2", f"password={common}"), ("o3", f"see {common} {key}"), ("o1", None), ("o1", ""), (None, "a" * 30 + " Password: ab, secret=abc"),
        ("o2", f"API_KEY='{key}'"), ("o4", "password=token: abcdefgh"),
    ]
    rows = [(i, t, o, "l") for i, (o, t) in enumerate(texts)] + [(0, texts[0][1], "o1", "l")]
    frame = stage(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), "secret-test")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = credentials.find_secrets(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id][1] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)), t
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert bool(r.live) == (r.doc_id == 0) and bool(r.copied) == (r.doc_id in (1, 2, 6))
    found = credentials.find_secrets(empty)
    assert found.count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")]


def test_urls_and_their_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "HTTP://WWW.Example.ORG/es/a?q", None), (2, "http://a.example.org/en/12#x", ""), (3, "https://x.net/p", link.format("https://b.com/de/p")),
        (4, "http://y.net/q?utm_source=z", '<meta http-equiv="refresh" content="0; url=https://x.net/p">'), (5, "no scheme", "x"), (6, None, None),
        (7, "https://m.net/r", link.format("https://ok.org/r")), (8, "https://n.net/s", link.format("https://m.net/r") + '<meta property="og:url" content="https://c.com/de/s">'),
        (9, "https://example.org", None), (9, "https://example.org", None), (10, "https://y.net/q/", None), (11, "https://rel.net/a", link.format("/b")), (12, "ftp://h?x://y/z", None),
    ]
    frame = stage(spark.createDataFrame(pages, "page_id long, url string, html string"), "pages-test")
    got = {r.page_id: r for r in urls.judge_urls(frame, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    seen = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert seen[1] == ("www.example.org", "/es/a", "example.org/es/", "block") and seen[2] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert [seen[i][2:] for i in (3, 4, 10)] == [(None, "block")] * 3  # aliases of a blocked url
    assert [seen[i][2:] for i in (7, 8)] == [(None, "allow")] * 2  # an allowed alias comes before a blocked one
    assert seen[5] == ("", "", None, "allow") and seen[6] == ("", "", None, "allow") and seen[9] == ("example.org", "", None, "allow")
    assert seen[12][:2] == ("h", "") and got[11].component == "https://rel.net/a"
    assert urls.judge_urls(stage(frame.limit(0), "no-pages"), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


@pytest.mark.parametrize("period_rows", [2, 20_000])
def test_revisits(spark, period_rows):
    tag = lambda e: {"etag": e, "content-length": "9", "date": "d1"}
    new = lambda e: {"etag": e, "content-length": "0", "date": "d2"}
    rows = [
        (1, "http://H.com:80/a#f", 10, "response", 200, "p1", tag('"1"')), (2, "http://h.com/a", 20, "revisit", 304, None, new('W/"1"')),
        (3, "http://h.com/a", 30, "response", 500, "p2", None), (4, "http://h.com/a", 40, "response", 200, "p3", tag('"2"')),
        (5, "http://h.com/a", 50, "revisit", 304, None, new('"1"')), (6, "http://h.com/b", 5, "revisit", 304, None, None),
        (7, None, 60, "revisit", 304, None, None), (8, "http://h.com/a", None, "revisit", 304, None, None), (9, "http://h.com/a", 50, "revisit", 304, "p4", new('"2"')),
        (10, "http://h.com/a", 50, "revisit", 304, "p3", None), (10, "http://h.com/a", 50, "revisit", 304, "p3", None), (11, "http://h.com/a", 50, None, 304, None, None),
    ]
    frame = spark.createDataFrame(rows, "record_id long, uri string, ts long, kind string, status int, payload_digest string, headers map<string,string>")
    frame = frame.withColumn("ts", F.timestamp_seconds("ts")).withColumn("key", F.lit("clash"))
    got = warc.resolve_revisits(frame, period_rows).collect()
    by_id = {r.record_id: (r.response_id, r.outcome) for r in got}
    assert by_id == {
        2: (1, "resolved"), 5: (4, "mismatch"), 6: (None, "no_response"), 7: (None, "no_response"), 8: (None, "no_response"), 9: (4, "mismatch"), 10: (4, "resolved"),
    } and len(got) == 8
    merged = next(r for r in got if r.record_id == 2)
    assert merged.headers == {"etag": 'W/"1"', "content-length": "9", "date": "d2"} and merged.payload_digest == "p1"
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_components_stop_at_stars_and_take_few_tasks(spark, monkeypatch):
    """Edges that are stars already take no round; a round over few edges reads them in few tasks."""
    rounds = []
    monkeypatch.setattr(components_of, "_large_star", lambda edges, f=components_of._large_star: rounds.append(edges.rdd.getNumPartitions()) or f(edges))
    stars = spark.createDataFrame([(9, k) for k in range(10, 40)] + [(2, 1), (None, 4), (3, 3)], "a long, b long").repartition(64)
    got = {r.node: r.component for r in components(stars, "a", "b").collect()}
    assert not rounds and got == {k: 9 for k in range(9, 40)} | {1: 1, 2: 1}
    path = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long").repartition(64)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = {r.node: r.component for r in components(path, "a", "b").collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(7)} and rounds and max(rounds) <= 16
