"""Secret scans with the corpus-wide frequency of each candidate.

Patterns find candidates with their places; the hash of each candidate is counted
over different repositories and owners. What many owners have is a copied example;
what few have and looks random is a live credential. All of it are DataFrame
expressions: places come from the lengths of the pieces between the matches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import number_rows, stage, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the method: long unbroken runs.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")


def _places(text: Column, pattern: str, group: int, least: int) -> Column:
    """``start, end, value`` of leftmost matches that do not overlap; those whose ``group`` has under ``least`` characters are dropped."""
    lengths = lambda column: F.transform(column, lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.slice(lengths(F.split(text, pattern, -1)), F.lit(1), F.size(found))
    steps = F.zip_with(between, F.arrays_zip(lengths(found).alias("n"), value.alias("v")), lambda gap, x: F.struct(gap.alias("gap"), x["n"].alias("n"), x["v"].alias("v")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    walked = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["v"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kept = F.filter(walked, lambda x: F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def scan(docs: DataFrame, text: str) -> DataFrame:
    """Add the arrays ``assign, access, hex, runs`` of places."""
    t = F.col(text)
    return docs.withColumns({
        "assign": _places(t, ASSIGN, 2, 6), "access": _places(t, ACCESS, 0, 20), "hex": _places(t, HEX, 0, 24), "runs": _places(t, RUN, 0, 20),
    })


def looks_random(value: Column) -> Column:
    """Digits and letters mixed, and at least ten different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def frequency(candidates: DataFrame, digest: str, repository: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """``digest, n_repositories, n_owners``: different ones, deduplicated on the map side before they are counted."""
    pairs = candidates.groupBy(digest, F.struct(*owner).alias("o"), F.struct(*repository).alias("r")).agg(F.lit(1).alias("one"))
    per_owner = pairs.groupBy(digest, "o").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy(digest).agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind in the order of :data:`KINDS`, then end."""
    ordered = F.array_sort(spans)
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _spans(places: Column, kind: int) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: Sequence[str] = ("source",),
    repository: Sequence[str] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2,
) -> DataFrame:
    """``doc_id, assign, access, hex, live, copied, base, spans`` for every row of ``docs``.

    ``assign, access, hex`` are the pattern matches with places and values in
    code points. ``live`` are candidates (matched values and long unbroken runs)
    that look random and that at most ``max_owners`` owners in at most
    ``max_repositories`` repositories have; ``copied`` are those that more have.
    ``base`` and ``spans`` list the places as text, the latter with ``live``.

    A null text is empty and has none; a null owner or repository is one of its
    own; the same candidate twice in a document counts once; repeated rows are
    scanned alike; an empty table gives no row. Columns besides those named are
    not looked at. ``docs`` must be a scan of files or staged, as its rows are
    numbered.
    """
    owners, repos = [f"_o{i}" for i in range(len(owner))], [f"_r{i}" for i in range(len(repository))]
    plain = number_rows(docs.select(
        F.col(doc_id).alias("_id"), text_of(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip(owner, owners)],
        *[F.col(c).alias(n) for c, n in zip(repository, repos)],
    ), "_row")
    found = stage(scan(plain, "_text").drop("_text"), "secrets")
    # a candidate is named by its value; the place is the value's inside an assignment
    inner = F.transform("assign", lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    # a run that overlaps a pattern's value is that value and no candidate of its own
    taken = F.concat(inner, "access", "hex")
    alone = F.filter("runs", lambda r: ~F.exists(F.col("_taken"), lambda x: (x["start"] < r["end"]) & (r["start"] < x["end"])))
    inside = F.filter("_named", lambda r: ~F.exists(F.col("_named"), lambda x: (x["start"] <= r["start"]) & (r["end"] <= x["end"]) & ((x["start"] < r["start"]) | (r["end"] < x["end"]))))
    candidates = (
        found.where("size(assign) + size(access) + size(hex) + size(runs) > 0")
        .withColumn("_taken", taken).withColumn("_named", F.array_distinct(F.concat("_taken", alone)))
        .select("_row", *owners, *repos, F.explode(inside).alias("c"))
        .select("_row", *owners, *repos, "c.start", "c.end", F.unhex(F.sha2("c.value", 256)).alias("digest"), looks_random(F.col("c.value")).alias("random"))
    )
    counted = frequency(candidates, "digest", repos, owners)
    rare = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")
    judged = candidates.where("random").join(counted, "digest").groupBy("_row").agg(
        F.collect_list(F.when(rare, span)).alias("_live"), F.collect_list(F.when(~rare, span)).alias("_copied")
    ).withColumnRenamed("_row", "_r")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    done = found.join(judged, found["_row"] == judged["_r"], "left").withColumns({
        "live": F.array_sort(F.coalesce("_live", none)), "copied": F.array_sort(F.coalesce("_copied", none)),
        "_base": F.concat(_spans(F.col("assign"), 0), _spans(F.col("access"), 1), _spans(F.col("hex"), 2)),
    })
    return done.select(
        F.col("_id").alias(doc_id), "assign", "access", "hex", "live", "copied", joined(F.col("_base")).alias("base"),
        joined(F.concat("_base", "live")).alias("spans"),
    )
