"""Operator 7, secret scans with corpus-wide ownership frequency.

Candidates are the base matches (assign, access, hex) and matches of well-known token formats. Each candidate's value
is hashed, and hashes are counted over distinct repositories (documents) and owners (sources) of the whole corpus, in
three aggregations that each combine before they shuffle: distinct (hash, owner, repository), then (hash, owner), then
hash. A value that many repositories or owners hold is a widely copied example; one that few hold is owner-specific and
looks live. Base spans always stay; a token-format candidate becomes a span (kind ``live``) only if it looks live.

Null and empty texts have no spans. A null doc_id or source counts as one repository or owner. Repeated rows give
repeated results and count once as a repository. Texts are scanned whole, values are never shortened. Empty tables give
empty results. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, row_hash
from . import spans as sp

#: A value looks live while it is in at most so many repositories and of so many owners.
MAX_REPOSITORIES, MAX_OWNERS = 3, 1

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{16,}+"
# Publicly documented token formats.
TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|AIza[A-Za-z0-9_-]{30,}+|sk_live_[A-Za-z0-9]{20,}+|eyJ[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+)"
# Fixed order of the kinds.
KINDS = ("assign", "access", "hex", "live")


def candidates(text: Column) -> Column:
    """array<struct<start, rank, kind, end, hash>> of every candidate of a text that is not null."""

    def of(found: Column, kind: str, secret) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.md5(secret(m["value"])).alias("hash")))

    own = lambda v: F.regexp_replace(v, ASSIGN_HEAD, "")
    assigned = F.filter(sp.matches(text, ASSIGN), lambda m: F.length(own(m["value"])) >= 12)
    empty = F.expr("cast(array() as array<struct<start:long,end:long,value:string>>)")
    access = F.when(F.contains(text, F.lit("AKIA")), sp.matches(text, ACCESS)).otherwise(empty)
    return F.concat(of(assigned, "assign", own), of(access, "access", lambda v: v), of(sp.matches(text, HEX), "hex", lambda v: v), of(sp.matches(text, TOKEN), "live", lambda v: v))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners of candidates (doc_id, source, hash) over the whole corpus."""
    once = found.groupBy("hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "source").agg(F.count("one").alias("held"))
    return by_owner.groupBy("hash").agg(F.sum("held").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def _judge(rows: DataFrame, max_repositories: int, max_owners: int) -> DataFrame:
    """(row, found) of candidates in (row, doc_id, source, found), each with its verdict ``live``."""
    each = rows.where(F.size("found") > 0).select("row", "doc_id", "source", F.explode("found").alias("c")).select("row", "doc_id", "source", "c.*")
    counted = each.join(ownership(each.select("doc_id", "source", "hash")), "hash")
    live = (F.col("repositories") <= max_repositories) & (F.col("owners") <= max_owners)
    return counted.withColumn("live", live).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "hash", "live"))).alias("found"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found")]


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with the candidates that look live masked in the text, and n_chars, if there, brought up to date."""
    # a row is known by its doc_id and the hash of all its columns
    keyed = docs.withColumn("__row", F.struct(row_hash(docs).alias("hash"), F.col("doc_id").cast("long").alias("id"), F.col("doc_id").isNull().alias("none")))
    rows = materialize(keyed.select(F.col("__row").alias("row"), *_columns(docs)).where(F.size("found") > 0).dropDuplicates(["row"]))
    live = _judge(rows, max_repositories, max_owners).select(F.col("row").alias("__row"), F.filter("found", lambda c: c["live"]).alias("__live")).where(F.size("__live") > 0)

    # where the masked part of the text has reached after each span; a span that begins before that adds nothing
    upto = sp.running(F.transform("__live", lambda c: c["end"]), F.greatest, 0)
    before = F.concat(F.array(F.lit(0).cast("long")), upto)
    piece = lambda c, k: F.when(c["start"] >= F.get(before, k), F.concat(F.substring(F.col("text"), (F.get(before, k) + 1).cast("int"), (c["start"] - F.get(before, k)).cast("int")), F.lit(mask))).otherwise(F.lit(""))
    masked = F.concat(F.array_join(F.transform("__live", piece), ""), F.substring(F.col("text"), (F.element_at(before, -1) + 1).cast("int"), F.lit(2147483647)))
    out = keyed.join(live.withColumnRenamed("__row", "__live_row"), F.col("__row").eqNullSafe(F.col("__live_row")), "left").withColumn("text", F.when(F.col("__live").isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__live").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def secret_scan(docs: DataFrame, max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row of counts and spans for each row of ``docs`` (doc_id, text, source)."""
    rows = materialize(docs.select(*_columns(docs)).withColumn("row", F.monotonically_increasing_id()))
    judged = _judge(rows, max_repositories, max_owners)
    out = rows.select("row", "doc_id").join(judged, "row", "left")
    found = F.coalesce("found", F.expr("cast(array() as array<struct<start:long,rank:int,kind:string,end:long,hash:string,live:boolean>>)"))
    out = out.select("doc_id", found.alias("found")).select("doc_id", "found", F.filter("found", lambda c: c["kind"] != "live").alias("base"), F.filter("found", lambda c: (c["kind"] != "live") | c["live"]).alias("kept"))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(sp.digest_text(F.col("base")), 256).alias("base_sha256"),
        sp.digest_text(F.col("kept")).alias("spans"),
        F.size(F.filter("found", lambda c: c["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda c: ~c["live"])).cast("long").alias("n_example"),
    )
