"""The corpus queries and their SQL: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeledger.llm import (
    chatformat, credentials, exact, mixing, packing, phrases, quality, ranked, simhash, suffixes, toxicity, urls, warc,
)
from scopeledger.llm.common import stage

#: Fixed values of the url query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
WEIGHTS = (5, 2, 1)
CAP_EPOCHS = 3.0
REPEAT_BYTES = 400
SEQUENCE_TOKENS = 2048
TOXIC_THRESHOLD = 0.3
ALPHA, DELTA = 0.005, 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str, str]:
    """Both file forms of the byte-level vocabulary and its word pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document and whether it stays."""
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text")
    judged = quality.judge(stage(measured, "measured"), table(spark, sf_dir, "labels"), alpha=ALPHA, delta=DELTA)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rules_failed", ",").alias("rules_failed"),
    )


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left without strings of 400 bytes that come again."""
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"), size=REPEAT_BYTES)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out rows are not used."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    scored = toxicity.score_texts(
        docs, docs.where(~held_out), labels.where(~held_out).select("doc_id", "toxic"), threshold=TOXIC_THRESHOLD
    )
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix_plan(table(spark, sf_dir, "documents"), WEIGHTS, CAP_EPOCHS).select(
        "doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies")
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document and which candidates look live."""
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2("base", 256).alias("base_sha256"), "spans", F.size("live").cast("long").alias("n_live"),
        F.size("copied").cast("long").alias("n_copied"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log that follows from the pages: a response of each, later revisits, some changed, failed or too early."""
    begin = 1_700_000_000
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    at = F.col("page_id") * 60 + begin
    dated = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))

    def headers(**named):
        pairs = [F.struct(F.lit(k.replace("_", "-")).alias("k"), v.alias("v")) for k, v in named.items()]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))

    full = headers(
        content_length=F.length("html").cast("string"), content_type=F.lit("text/html"),
        etag=F.when(F.col("page_id") % 7 != 0, tag), last_modified=dated,
    )
    again = headers(
        cache_control=F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string")), content_length=F.lit("0"), date=at.cast("string"),
        etag=F.when(F.col("page_id") % 13 == 0, F.lit('"changed"')).when(F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag),
        last_modified=dated,
    )
    status = F.when(F.col("page_id") % 11 == 0, 500).otherwise(200)
    records = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("response").alias("kind"), at.alias("s"), status.alias("status"), F.md5("html").alias("payload_digest"), full.alias("headers")),
        F.struct(F.lit(1).alias("n"), F.lit("revisit").alias("kind"), (at + 3600 * (1 + F.col("page_id") % 5)).alias("s"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("payload_digest"), again.alias("headers")),
        F.when(F.col("page_id") % 4 == 0, F.struct(F.lit(2).alias("n"), F.lit("response").alias("kind"), (at + 7200).alias("s"), F.lit(200).alias("status"), F.md5(F.concat("html", F.lit("2"))).alias("payload_digest"), full.alias("headers"))),
        F.when(F.col("page_id") % 17 == 0, F.struct(F.lit(3).alias("n"), F.lit("revisit").alias("kind"), (at - 60).alias("s"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("payload_digest"), again.alias("headers"))),
    )
    made = pages.select("page_id", "url", F.explode(F.array_compact(records)).alias("c"))
    return made.select(
        (F.col("page_id") * 4 + F.col("c.n")).alias("record_id"), F.col("url").alias("uri"), F.timestamp_seconds("c.s").alias("ts"),
        "c.kind", "c.status", "c.payload_digest", "c.headers",
    )


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response that each revisit of the capture log stands for."""
    found = warc.resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return found.select("record_id", "response_id", "outcome", "payload_digest", lines.alias("headers"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_paths(), limit=SEQUENCE_TOKENS)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its training examples, with one whose texts hold the markers."""
    says = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return chatformat.digests(chatformat.expand_prefixes(turns))


QUERIES = {
    f.__name__: f for f in (
        op1_url_rules, op2_quality_rules, op3_repeated_strings, op4_exact_dedup, op5_toxicity, op6_mix, op7_simhash, op8_secrets,
        op9_revisits, op10_pack, op11_phrases, op12_ranked_search, op13_chat,
    )
}

ORACLES = {
    "op4_exact_dedup": r"""
        with t as (
            select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
        ), g as (
            select *, first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
                   count(*) over (partition by norm) as group_size
            from t
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g""",
    "op9_revisits": r"""
        with p as (
            select page_id, url, html, 1700000000 + page_id * 60 as visited, '"' || md5(html) || '"' as tag,
                   'day ' || (page_id % 28) as dated,
                   case when regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) <> '' then
                     regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1')
                     || case when regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) = '' then '/'
                             when regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) like '?%'
                             then '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)
                             else regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) end else url end as key
            from pages
        ), r as (
            select page_id * 4 as record_id, key, visited as s, md5(html) as digest, length(html) as n,
                   case when page_id % 7 <> 0 then tag end as etag, dated
            from p where page_id % 11 <> 0
            union all
            select page_id * 4 + 2, key, visited + 7200, md5(html || '2'), length(html), case when page_id % 7 <> 0 then tag end, dated
            from p where page_id % 4 = 0
        ), v0 as (
            select page_id, key, visited, visited + 3600 * (1 + page_id % 5) as s, page_id * 4 + 1 as record_id, tag, dated from p
            union all
            select page_id, key, visited, visited - 60, page_id * 4 + 3, tag, dated from p where page_id % 17 = 0
        ), v as (
            select record_id, key, s, visited, page_id % 100 as age, dated,
                   case when page_id % 13 = 0 then '"changed"' when page_id % 3 = 0 then 'W/' || tag else tag end as etag
            from v0
        ), e as (
            select record_id, key, s, null::bigint as response_id from v
            union all select record_id, key, s, record_id from r
        ), f as (
            select record_id, last_value(response_id ignore nulls) over (
                       partition by key order by s, record_id rows between unbounded preceding and 1 preceding) as found
            from e
        ), j as (
            select v.*, r.record_id as response_id, r.digest, r.n, r.etag as old_tag, r.dated as old_date,
                   case when r.record_id is null then 'no_response'
                        when r.etag is not null then case when r.etag = regexp_replace(v.etag, '^W/', '') then 'resolved' else 'mismatch' end
                        when r.dated = v.dated then 'resolved' else 'mismatch' end as outcome
            from v join f using (record_id) left join r on r.record_id = f.found
        )
        select record_id, response_id, outcome, case when outcome = 'resolved' then digest end as payload_digest,
               case when outcome = 'resolved' then 'cache-control=max-age=' || age || '; content-length=' || n
                    || '; content-type=text/html; date=' || visited || '; etag=' || etag || '; last-modified=' || dated end as headers
        from j""",
    "op11_phrases": r"""
        with docs as (
            select row_number() over () as row, coalesce(lang, 'und') as lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents
        ), pieces as (
            select lang, row_number() over () as piece, string_split_regex(piece, '[\x20\x09]+') as w
            from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from docs)
        ), clean as (
            select lang, piece, list_filter(w, lambda x: x <> '') as w from pieces
        ), starts as (
            select lang, w, unnest(range(1, len(w) + 1)) as i from clean
        ), spans as (
            select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as k from starts
        ), f as (
            select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as f
            from spans group by all having count(*) >= 100
        ), sizes as (
            select lang, sum(len(w))::bigint as n from clean group by lang
        ), covered as (
            select lang, array_to_string(string_split(phrase, ' ')[1:k - 1], ' ') as phrase, f from f where k >= 3
            union select lang, array_to_string(string_split(phrase, ' ')[2:k], ' '), f from f where k >= 3
        ), kept as (
            select * from f where k >= 2 and not exists (select 1 from covered c where c.lang = f.lang and c.phrase = f.phrase and c.f = f.f)
        ), cuts as (
            select lang, phrase, f as a, string_split(phrase, ' ') as w, k, unnest(range(1, k)) as cut from kept
        ), scored as (
            select c.lang, c.phrase, c.a, l.f as l, r.f as r, s.n, c.cut,
                   ((1000::hugeint * c.a * s.n) // (l.f::hugeint * r.f))::bigint as score
            from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.cut], ' ')
            join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
            join sizes s on s.lang = c.lang
        ), best as (
            select *, row_number() over (partition by lang, phrase order by score, cut) as nth from scored
        ), ranked as (
            select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
            from best where nth = 1
        )
        select * from ranked where rank <= 2000""",
    "op12_ranked_search": r"""
        with d as (
            select row_number() over () as row, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
            from documents where text is not null
        ), held as (
            select *, len(terms) as n from d where len(terms) > 0
        ), size as (
            select count(*) as docs, sum(n)::bigint as length from held
        ), q as (
            select row_number() over () as item, item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark where text is not null
        ), asked as (
            select item, item_id, term, count(*) as times from q group by all
        ), tf as (
            select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(terms) as term from held) group by all
        ), df as (
            select term, count(*) as df from tf group by term
        ), scores as (
            select item, item_id, row, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
                   * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::bigint as score
            from asked join tf using (term) join df using (term), size group by all
        ), ranked as (
            select item_id, row_number() over (partition by item order by score desc, doc_id, row)::integer as rank, doc_id, score
            from scores where score > 0
        )
        select * from ranked where rank <= 20""",
    "op13_chat": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), s as (
            select *, 24 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g'))
                   + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as size from t
        ), w as (
            select *, sum(size) over (partition by conv_id order by turn, role, text rows unbounded preceding) as so_far,
                   row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back from s
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(so_far) filter (role = 'assistant' or back = 1)::bigint as formatted_chars
        from w group by conv_id""",
}
