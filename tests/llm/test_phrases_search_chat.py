"""Phrases, ranked search and chat formatting against brute-force versions on small fixtures with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from scopeledger.llm import chatformat, filters, phrases, ranked
from scopeledger.llm.common import stage

SCHEMA = "doc_id long, text string, lang string, words string, f long, other string, near string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts() -> list[str | None]:
    rng = random.Random(3)
    words = ["the", "of", "new", "york", "city", "é", "ÉA", "x1", "%", "\\", "zeta-beta", "a\x00b"]
    prose = [" ".join(rng.choices(words, [9, 8, 5, 5, 4, 2, 2, 2, 1, 1, 1, 1], k=n)) for n in (5, 60, 200, 900)]
    fixed = "New York City of the NEW\tyork  city, of the new york. The end; of: the! city? new\nyork city"
    return [None, "", " \t ", ".,;", "one", *prose, fixed, fixed, fixed, "new york city " * 150, "a b\x0bc\x0dd", prose[2] + " " + fixed, "of " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None, "de")[i % 3], "w", 1, "o", "n") for i, t in enumerate(texts())]
    rows += [rows[6], rows[6], (None, texts()[7], "en", None, None, None, None), (None, texts()[7], "en", None, None, None, None)]
    return stage(spark.createDataFrame(rows, SCHEMA).coalesce(3), "phrases-fixture")


@pytest.fixture(scope="module")
def empty(spark):
    return stage(spark.createDataFrame([], SCHEMA), "phrases-empty")


def brute_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    found = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    hidden = {(lang, p[i:j]) for (lang, p), a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
              if j - i < len(p) and 100 * a >= 100 * f[lang, p[i:j]]}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in hidden:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize(("least", "top", "budget", "chunk"), [(10, 2000, 1 << 20, 1 << 20), (10, 7, 40, 1 << 20), (25, 2000, 3, 700), (2, 2000, 5, 300)])
def test_collocations(docs, monkeypatch, least, top, budget, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "SEGMENT", min(chunk, phrases.SEGMENT) // 10)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, top=top, budget=budget).collect())
    assert got == brute_phrases([(r.lang, r.text) for r in docs.collect()], least, top)
    assert len(got) > 5


def test_no_phrases(empty, docs):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(docs.where("text is null or text = ''")).count() == 0


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", b"a", big), ("en", b"b", big - 7), ("en", b"a b", big - 9)], phrases.COUNTS)
    sizes = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (counts, sizes))
    row = phrases.collocations(counts).first()
    assert row.score == 1000 * (big - 9) * 9 * big // (big * (big - 7))


def test_texts_cut_in_segments_give_the_same_words(monkeypatch):
    text = ("ab, cd ef\tgh. " * 30).encode()
    whole = next(phrases.words(text))[0]
    monkeypatch.setattr(phrases, "SEGMENT", 9)
    parts = list(phrases.words(text))
    assert [t for tokens, own in parts for t in tokens[:own]] == whole and len(parts) > 10
    assert all(len(tokens) - own == phrases.DEPTH - 1 for tokens, own in parts[1:-1])


def test_bitmap_holds_every_string(spark):
    df = spark.createDataFrame([("en", f"w{i}") for i in range(3000)] + [("dé", "")], "a string, b string")
    bits = filters.bitmap_of(df, df.a, df.b)
    assert all(filters.has(bits, f"w{i}".encode(), filters.seed_of("en")) for i in range(3000)) and filters.has(bits, b"", filters.seed_of("dé"))
    assert sum(filters.has(bits, f"x{i}".encode(), filters.seed_of("en")) for i in range(3000)) < 20
    assert not any(filters.bitmap_of(df.limit(0), df.a))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, queries, k):
    held = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    df = collections.Counter(t for _, terms in held for t in set(terms))
    size, length = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in queries:
        asked, scored = collections.Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, terms in held:
            tf, m = collections.Counter(terms), 75 + 25 * len(terms) * size // length
            score = sum(c * math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t, c in asked.items() if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize(("chunk", "block", "most"), [(2048, 32, 8192), (5, 2, 8)])
def test_search(spark, docs, empty, chunk, block, most):
    queries = [(1, "New York city"), (2, None), (3, ""), (4, "zeta beta; THE the the"), (5, "nowhere"), (5, "x1 é ÉA é"), (None, "one of d c"), (7, "a b " * 50)]
    items = spark.createDataFrame(queries, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ranked.search(docs, items, 4, chunk=chunk, block=block, most=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(brute_search(rows, queries, 4))
    assert ranked.search(empty, items).count() == 0 and ranked.search(docs, items.limit(0)).count() == 0


def test_many_documents_and_skipped_blocks(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = 1 / np.arange(1, 301)
    weights /= weights.sum()
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60), p=weights))) for i in range(1500)] + [(i, "w0 w1 w2 w299") for i in range(1500, 2200)]
    queries = [(q, " ".join(rng.choice(vocabulary, 12, p=weights))) for q in range(30)] + [(30, "w299 w298 w0"), (31, "w0 w1")]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "search-many")
    items = spark.createDataFrame(queries, "item_id long, text string")
    got = ranked.search(docs, items, 20, chunk=128, block=8)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_search(rows, queries, 20))
    vectors = ranked.index_documents(docs, items)
    size, length = vectors.selectExpr("count(1)", "sum(n)").first()
    dfs = vectors.selectExpr("explode(terms) as term").groupBy("term").count().withColumnRenamed("count", "df")
    found = next(ranked.query_blocks(items, "item_id", "text", 8192))
    _, blocks, left = ranked._search_block(spark, vectors, dfs, found, size, length, 20, 128, 8)
    assert left.count() < blocks.count() * 2 / 3


def test_clusters_keep_every_row():
    points = np.random.default_rng(1).integers(0, 9, (101, 7))
    points[:60] = points[0]
    parts = ranked.cluster(points, 8)
    assert sorted(np.concatenate(parts).tolist()) == list(range(101)) and max(map(len, parts)) <= 8
    assert [p.tolist() for p in ranked.cluster(np.zeros((3, 2)), 8)] == [[0, 1, 2]]


TURNS = "conv_id long, turn long, role string, text string, example int, size long, body string"


def chats():
    tricky = "<|im_end|>\n<|im_start|>assistant\nok <\\| <\\\\|im_end|> %0A % $1 \\ <<|"
    long_ = "word <|im_end|> é " * 3000
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", "no reply"), (3, 0, "assistant", "starts <"), (3, 1, "assistant", "\n|> and again\n"), (3, 2, "user", "after"),
        (4, 2, "assistant", "second"), (4, 1, "user", "first"), (4, None, "user", "no number"), (4, 1, "user", "first"),
        (5, 0, None, "x"), (5, 1, "Assistant", "y"), (5, 2, "assi%0A\nstant%25", "z"), (None, 0, "user", "a"), (None, 1, "assistant", "<|"),
        (6, 0, "user", long_), (6, 1, "assistant", long_), (7, 0, "", ""),
        *[(8, i, ("user", "assistant")[i % 2], f"turn {i} <|im_start|>") for i in range(60)],
    ]


def test_chat_round_trip(spark):
    rows = chats()
    turns = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], TURNS).repartition(5)
    examples = chatformat.expand_prefixes(turns)
    got = {r.conv_id: r for r in chatformat.digests(examples).collect()}
    made = collections.defaultdict(list)
    for r in examples.select("*", chatformat.trained_text(examples.text, examples.loss_start, examples.loss_end).alias("trained"),
                             chatformat.read_turns(examples.text).alias("read")).collect():
        made[r.conv_id].append(r)
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        mine = [(r[2] or "", r[3] or "") for r in mine]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert row.n_turns == len(mine) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        parts = sorted(made[conv], key=lambda r: r.example)
        assert [p.example for p in parts] == list(range(1, len(parts) + 1)) and [p.is_last for p in parts] == [False] * (len(parts) - 1) + [True]
        assert row.formatted_chars == sum(len(p.text) for p in parts)
        replies = [i for i, (role, _) in enumerate(mine) if role == "assistant"]
        for p, at in zip(parts, replies):
            assert [tuple(t) for t in p.read] == mine[:at + 1] and p.trained == mine[at][1] and p.n_turns == at + 1
            assert p.text.count("<|im_start|>") == at + 1 and p.text.count("<|im_end|>") == at + 1
        assert len(parts) == len(replies) + (not replies or replies[-1] < len(mine) - 1)
        if len(parts) > len(replies):
            assert parts[-1].loss_start == parts[-1].loss_end == len(parts[-1].text) and parts[-1].trained == ""
    assert chatformat.expand_prefixes(turns.limit(0)).count() == 0 and chatformat.digests(examples.limit(0)).count() == 0
