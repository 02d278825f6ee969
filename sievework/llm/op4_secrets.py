"""Secret scans with corpus-wide ownership frequency.

Candidates of every text are hashed and counted over the whole corpus by distinct owners (sources) and
repositories (different texts; exact copies of a text are one repository, whoever holds them).  A value is a widely
copied example if ``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories carry it, and looks live
otherwise.  So a real credential stays live when its document is copied to a second owner, and what stands in many documents
of one owner does not look live.  Three kinds of span are always reported.  A fourth, long mixed
strings that nothing announces, is reported only where the counts say that it looks live.

Null texts have no span.  Every input row gives one row, repeated rows alike; a repeated row does not
add a repository or an owner.  A null owner counts as one of its own.  Texts are told apart by 64 bits, values leave the scan
only as SHA-256 digests.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .native import let, upto

#: Kinds in the order they are listed, their patterns, the group that holds the secret, its least length.
KINDS = [
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
#: The same texts have a match of the length that counts; cheaper than taking all short runs apart.
QUICK = {"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: What the counts may add: unannounced strings of this shape with a digit, a small and a capital letter.
GENERIC = ("generic", "[A-Za-z0-9+/_-]{32,}", 0, 32)
#: A value carried by so many owners, or in so many different texts, is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10

SPAN = "struct<kind:string,rank:int,start:int,stop:int,digest:string>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind, leftmost first, none overlapping; those of too short a secret are dropped after."""
    def located(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda between: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda secret: F.aggregate(
                upto(F.size(found)),
                F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
                lambda acc, i: let(acc["at"] + F.length(F.get(between, i)), lambda start: F.struct(
                    (start + F.length(F.get(found, i))).alias("at"),
                    F.when(F.length(F.get(secret, i)) >= least, F.array_append(acc["out"], F.struct(
                        F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"),
                        (start + F.length(F.get(found, i))).alias("stop"), F.sha2(F.get(secret, i), 256).alias("digest"))
                        .cast(SPAN))).otherwise(acc["out"]).alias("out"))),
                lambda acc: acc["out"])))

    return F.when(text.rlike(QUICK.get(kind, pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(
        F.array().cast(f"array<{SPAN}>"))


def _generic(text: Column, base: Column) -> Column:
    kind, pattern, group, least = GENERIC
    cut = F.substring(text, F.lit(1), F.length(text))
    mixed = "(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])"
    return F.filter(_spans(text, len(KINDS), kind, pattern, group, least), lambda s: (
        ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        & F.substring(cut, s["start"] + 1, s["stop"] - s["start"]).rlike("^" + mixed)))


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with row_, owner_, repository_ and candidate spans_."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({
        "row_": F.monotonically_increasing_id(), "owner_": owner, "repository_": F.xxhash64(text),
        "spans_": let(text, lambda t: let(F.concat(*(_spans(t, i, *kind) for i, kind in enumerate(KINDS))),
                                          lambda base: F.concat(base, _generic(t, base))))})


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, owner, repository and the candidate spans of every text."""
    return materialize(_scanned(docs).select("row_", F.col("doc_id").cast("long").alias("doc_id"), "owner_", "repository_", "spans_")
                       .toDF("row", "doc_id", "owner", "repository", "spans"), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate digest, counted in two steps so that a hot digest is spread."""
    each = found.select(F.struct("owner").alias("owner"), "repository",
                        F.explode(F.array_distinct(F.transform("spans", lambda s: s["digest"]))).alias("digest"))
    # written, so that the join of spans with it has plain shuffles on both sides and a hot secret is split
    return materialize(each.groupBy("digest").agg(F.count_distinct("owner").alias("n_owners"),
                                                  F.count_distinct("repository").alias("n_repositories")), "owners")


def _judged(found: DataFrame) -> DataFrame:
    """row and its spans in order, with what the corpus says of them; rows without spans are left out."""
    judged = found.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(ownership(found), "digest").withColumn(
        "live", (F.col("n_owners") < COPIED_OWNERS) & (F.col("n_repositories") < COPIED_REPOSITORIES)).where((F.col("kind") != GENERIC[0]) | F.col("live"))
    return judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "rank", "stop", "kind", "digest", "n_owners", "n_repositories", "live"))).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans with what the corpus says of them, for every row.

    A span has kind, start, stop, digest, n_owners, n_repositories and live; generic ones are there only if live.
    """
    found = candidates(docs)
    per_row = _judged(found)
    return found.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_digest(docs: DataFrame) -> DataFrame:
    """Counts of the three base kinds, the digest of their spans, and all spans, for every row."""
    base = F.filter("spans", lambda s: s["kind"] != GENERIC[0])
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind)
    return scan(docs).select(
        "doc_id", *(of_kind(kind).alias(f"n_{kind}") for kind, *_ in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))


def _blanked(text: Column, spans: Column, mark: str) -> Column:
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["stop"].alias("at"))
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at")))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def blank_out(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with its columns, every reported span of the text replaced by ``mark``, overlapping ones by one."""
    found = materialize(_scanned(docs), "scanned")
    place = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))
    # only unannounced strings depend on the corpus, so only texts that have one are joined
    waits = F.exists("spans_", lambda s: s["kind"] == GENERIC[0])
    judged = _judged(found.select("row_", "owner_", "repository_", "spans_").toDF("row", "owner", "repository", "spans"))
    sure = found.where(~waits).withColumn("spans_", F.transform("spans_", place))
    late = found.where(waits).drop("spans_").join(
        judged.select(F.col("row").alias("row_"), F.transform("spans", place).alias("spans_")), "row_", "left")
    return sure.unionByName(late).withColumn("text", F.when(
        F.size("spans_") > 0, _blanked(F.col("text"), F.col("spans_"), mark)).otherwise(F.col("text"))).select(*docs.columns)
