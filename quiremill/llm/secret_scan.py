"""Secret scan with ownership frequency, in DataFrame operations only.

Candidates are found by three patterns in every whole text. The hash of each
candidate's value is counted over the corpus by distinct repositories and owners: a
value that many owners or many repositories hold is a widely copied example; one that
stays with few and looks random is a live-looking credential of its owner, and one that
does not look random is a weak value. These verdicts are added as spans of their own
beside the base spans, one for each candidate.

Defined results: a null or empty text has no spans; a null source is an owner of its
own; a value found twice in one text counts once for its owner; repeated rows get the
same spans and are one owner; an empty table gives an empty table; further columns,
those named like results among them, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import join_hot, written

# The base patterns, the group that holds the value, and the shortest value or match.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Owners and repositories from which on a value counts as widely copied.
SHARED_OWNERS = 3
SHARED_REPOSITORIES = 5
#: Verdicts and their rank after the base kinds.
VERDICTS = {"live": 3, "example": 4, "weak": 5}
#: Distinct characters that a live-looking value has at least.
LIVE_CHARACTERS = 8
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your[_-]|xxxx|0123456789|1234567890|abcdefgh"

_SPAN = "array<struct<kind:string,rank:int,start:int,stop:int,value:string>>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of one kind: the gaps between matches and the matches themselves give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), begin.alias("start"), end.alias("stop"), x["value"].alias("value")
        )
        fits = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(pieces, start, step)["out"]
    return F.when(text.rlike(pattern), folded).otherwise(F.array().cast(_SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append ``spans``: kind, rank of the kind, start, stop (code points, end exclusive) and value, in order."""
    own = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_spans(own, kind, pattern, group, least, k) for k, (kind, pattern, group, least) in enumerate(BASE)])
    return docs.withColumn("spans", found).withColumn(
        "spans",
        F.when(F.size("spans") > 1, F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))).otherwise(
            F.col("spans")
        ),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repository, owner) rows to counts for each hash; repeats fold before they move."""
    held = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences")
    )


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each document: doc_id, base (spans), spans (base and verdicts), each as kind, rank, start, stop."""
    base = base_spans(docs.select("doc_id", "text", F.col(owner).alias("_owner"), F.struct(*repository).alias("_repository")))
    # Ids that are read back from the written table, and so stay as they are.
    base = written(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "_owner", "_repository", "spans"), "secrets")
    single = base.where(F.size("spans") > 0).select("row", "_owner", "_repository", F.explode("spans").alias("s"))
    value = F.col("s.value")
    candidates = single.select(
        "row",
        F.sha2(value.cast("binary"), 256).alias("hash"),
        F.coalesce(F.col("_owner").cast("string"), F.lit("")).alias("owner"),
        F.to_json("_repository").alias("repository"),
        F.col("s.start").alias("start"),
        F.col("s.stop").alias("stop"),
        (value.rlike(PLACEHOLDER)).alias("placeholder"),
        F.size(F.array_distinct(F.split(value, ""))).alias("characters"),
    )
    owned = written(ownership(candidates), "owners")
    shared = (F.col("owners") >= SHARED_OWNERS) | (F.col("repositories") >= SHARED_REPOSITORIES) | F.col("placeholder")
    kind = F.when(shared, "example").when(F.col("characters") >= LIVE_CHARACTERS, "live").otherwise("weak")
    judged = join_hot(candidates, owned, "hash").select("row", "start", "stop", kind.alias("kind"))
    rank = F.col("kind")
    rank = F.when(rank == "live", VERDICTS["live"]).when(rank == "example", VERDICTS["example"]).otherwise(VERDICTS["weak"])
    judged = judged.groupBy("row").agg(F.collect_set(F.struct("kind", rank.alias("rank"), "start", "stop")).alias("verdicts"))
    plain = "array<struct<kind:string,rank:int,start:int,stop:int>>"
    shown = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["stop"].alias("stop")))
    rows = base.select("row", "doc_id", shown.alias("base"))
    every = F.concat("base", F.coalesce("verdicts", F.array().cast(plain)))
    ordered = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    return rows.join(judged, "row", "left").select("doc_id", "base", ordered.alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
