"""Operator 1, personal data by weak supervision.

Candidates are the base matches (email, ip, card, phone) and weaker patterns (spelled-out addresses, national phone
numbers, account numbers, honorifics with a name). Three labelers vote on each candidate, for (1), against (-1) or not
at all (0): a regular-expression labeler on its form, a gazetteer labeler on its parts, and a context labeler on the
text before it. Votes are independent given the truth, so the corpus reduces to counts of vote patterns by kind, 27 for each
kind at most; expectation-maximisation on those counts estimates each labeler's reliabilities and every pattern's
posterior. The posteriors train the final classifier, a naive Bayes model with soft labels over features of the span
(kind and votes, length class, neighbouring characters); candidates that it accepts are added. Base spans always stay.

Everything runs as column expressions, the EM iterations as a fold over the pattern counts; the driver holds the bounded
parameter table only. Null and empty texts have no spans; texts are scanned whole. Repeated rows give repeated results.
Without candidates nothing is trained and nothing added. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import spans as sp

ITERATIONS, THRESHOLD = 40, 0.5
#: Characters before a candidate that the context labeler reads.
CONTEXT = 40

_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,63}+)++"
NATIONAL = r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}+(?:\x20[A-Z][a-z]{1,20}+)?"

# Fixed order of the kinds; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "spelled_email", "national_phone", "account", "name")
# The gazetteers.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|us|ca"
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
CARD_ISSUERS = "3[47]|4|5[1-5]|2[2-7]|6(?:011|5)"
PRIVATE_RANGES = r"(?:10|127|0)\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\."
FIRST_NAMES = "James|Mary|John|Anna|Maria|Peter|Paul|Michael|David|Sarah|Laura|Thomas|Robert|Linda|Jose|Luis|Carlos|Marie|Jean|Hans|Karl|Elena|Sofia|Daniel"
# Words that announce, and words that exclude, personal data.
ANNOUNCING = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|telephone|call|mobile|fax|card|visa|credit|account|iban|ssn|ip|address|host|server|name|by|from)\b[^A-Za-z]*+(?:is[^A-Za-z]*+)?$"
EXCLUDING = r"(?i)(?:\b(?:version|example|figure|table|isbn|order|invoice|part|serial|no)\b\.?[^A-Za-z]*+|[$#])$"


def _candidates(text: Column) -> Column:
    """array<struct<start, rank, kind, end, value>> of a text that is not null."""
    none = F.expr("cast(array() as array<struct<start:long,end:long,value:string>>)")
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")

    def card_ok(m: Column) -> Column:
        return F.when(F.length(digits(m["value"])).between(14, 19), sp.luhn(digits(m["value"]))).otherwise(False)

    has = lambda what, expr: F.when(F.contains(text, F.lit(what)), expr).otherwise(none)
    found = {
        "email": has("@", sp.matches(text, EMAIL)),
        "ip": F.filter(sp.matches(text, IP), lambda m: m["value"].rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")),
        "card": F.filter(sp.matches(text, CARD), card_ok),
        "phone": has("+", F.filter(sp.matches(text, PHONE), lambda m: F.length(digits(m["value"])).between(10, 15))),
        "spelled_email": F.when(F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), sp.matches(text, SPELLED)).otherwise(none),
        "national_phone": sp.matches(text, NATIONAL),
        "account": sp.matches(text, ACCOUNT),
        "name": sp.matches(text, NAME),
    }

    def named(rank: int, kind: str) -> Column:
        return F.transform(found[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(*[named(i, k) for i, k in enumerate(KINDS)])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))


def _votes(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """The votes of the form, gazetteer and context labelers."""
    by = lambda cases: F.coalesce(*[F.when(kind == k, v) for k, v in cases.items()], F.lit(0))
    m = lambda pattern: value.rlike(pattern)
    form = by({
        "email": _vote(m(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), m(r"\.\.|@-|-$|^[.-]")),
        "ip": _vote(m(r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), m(r"(?:^|\.)0[0-9]") | before.rlike(r"[0-9.]$") | after.rlike(r"^\.?[0-9]")),
        "card": _vote(m(r"^[0-9]{14,19}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$"), m(r"^0") | before.rlike(r"[0-9A-Za-z.]$")),
        "phone": _vote(m(r"^\+[1-9]"), m(r"\+0|\.\.|--|\x20\x20")),
        "spelled_email": _vote(m(r"(?:\(dot\)|\[dot\])"), m(r"^[.-]")),
        "national_phone": _vote(m(r"^\(?[2-9]"), m(r"^\(?[01]") | before.rlike(r"[0-9)-]\x20?$")),
        "account": _vote(m(r"^[A-Z]{2}"), m(r"^(?:000|666|9[0-9]{2})-")),
        "name": _vote(m(r"^[A-Za-z]+\.?\x20[A-Z][a-z]+\x20[A-Z][a-z]+$"), m(r"\x20[A-Z][a-z]{1,2}$")),
    })
    gazetteer = by({
        "email": _vote(m(rf"(?i)\.(?:{TOP_DOMAINS})$"), m(r"\.[0-9]+$")),
        "ip": _vote(~m(rf"^(?:{PRIVATE_RANGES})"), m(rf"^(?:{PRIVATE_RANGES})")),
        "card": _vote(m(rf"^(?:{CARD_ISSUERS})"), m(r"^[0189]")),
        "phone": _vote(m(rf"^\+(?:{CALLING_CODES})"), m(r"^\+0")),
        "spelled_email": _vote(m(rf"(?i)(?:{TOP_DOMAINS})$"), m(r"[0-9]$")),
        "national_phone": _vote(m(r"^\(?[2-9][0-9]{2}\)?[\x20.-]*[2-9]"), m(r"^\(?[0-9]11")),
        "account": _vote(m(r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT)[0-9]{2}|^[0-8]"), m(r"^00")),
        "name": _vote(m(rf"\x20(?:{FIRST_NAMES})(?:\x20|$)"), F.lit(False)),
    })
    return [form, gazetteer, _vote(before.rlike(ANNOUNCING), before.rlike(EXCLUDING))]


#: p holds a kind's prior and, for each labeler, the chance of a vote for (given that it votes) under either truth.
def _likelihood(truth: str) -> str:
    return f"aggregate(sequence(0, 2), 1D, (s, j) -> s * CASE WHEN x.v[j] = 1 THEN p.{truth}[j] WHEN x.v[j] = -1 THEN 1 - p.{truth}[j] ELSE 1D END)"


_POSTERIORS = f"transform(patterns, x -> named_struct('v', x.v, 'n', x.n, 'q', p.prior * {_likelihood('yes')} / (p.prior * {_likelihood('yes')} + (1 - p.prior) * {_likelihood('no')})))"
_STEP = f"""named_struct(
  'prior', (1 + aggregate({_POSTERIORS}, 0D, (s, x) -> s + x.n * x.q)) / (2 + aggregate(patterns, 0D, (s, x) -> s + x.n)),
  'yes', transform(sequence(0, 2), j -> (4 + aggregate({_POSTERIORS}, 0D, (s, x) -> s + IF(x.v[j] = 1, x.n * x.q, 0D))) / (5 + aggregate({_POSTERIORS}, 0D, (s, x) -> s + IF(x.v[j] != 0, x.n * x.q, 0D)))),
  'no', transform(sequence(0, 2), j -> (1 + aggregate({_POSTERIORS}, 0D, (s, x) -> s + IF(x.v[j] = 1, x.n * (1 - x.q), 0D))) / (5 + aggregate({_POSTERIORS}, 0D, (s, x) -> s + IF(x.v[j] != 0, x.n * (1 - x.q), 0D)))))"""
_START = "named_struct('prior', 0.7D, 'yes', array(0.8D, 0.8D, 0.8D), 'no', array(0.3D, 0.3D, 0.3D))"


def reliabilities(votes: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """kind, v, n, posterior of each vote pattern, and the reliabilities ``p`` of its kind, from rows (kind, v)."""
    counts = votes.groupBy("kind", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    grouped = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    fitted = grouped.withColumn("p", F.expr(f"aggregate(sequence(1, {iterations}), {_START}, (p, i) -> {_STEP})"))
    return fitted.select("kind", "p", F.explode(F.expr(_POSTERIORS)).alias("x")).select("kind", "x.v", "x.n", F.col("x.q").alias("posterior"), "p")


def _features() -> dict[str, Column]:
    votes = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    return {
        "votes": F.concat_ws("|", "kind", votes),
        "length": F.concat_ws("|", "kind", F.floor(F.log2((F.col("end") - F.col("start")).cast("double"))).cast("string")),
        "before": F.concat_ws("|", "kind", "left"),
        "after": F.concat_ws("|", "kind", "right"),
    }


def _neighbour(piece: Column) -> Column:
    return F.when(F.length(piece) == 0, "edge").when(piece.rlike(r"^\s$"), "space").when(piece.rlike("^[0-9]$"), "digit").when(piece.rlike(r"^[\p{L}]$"), "letter").otherwise("sign")


def detect(docs: DataFrame, threshold: float = THRESHOLD, iterations: int = ITERATIONS) -> DataFrame:
    """One row of counts and spans for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", _candidates(F.col("text")).alias("found"))
    cut = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"), F.substring("text", F.greatest(m["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(m["start"], F.lit(CONTEXT)).cast("int")).alias("pre"), F.substring("text", (m["end"] + 1).cast("int"), F.lit(2)).alias("post")))
    voted = F.transform(cut, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["kind"].alias("kind"), m["end"].alias("end"), F.array(*_votes(m["kind"], m["value"], m["pre"], m["post"])).alias("v"), _neighbour(F.substring(m["pre"], -1, 1)).alias("left"), _neighbour(F.substring(m["post"], 1, 1)).alias("right")))
    rows = materialize(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.size("found") > 0, voted).alias("found")))
    each = rows.where("found is not null").select("row", F.explode("found").alias("c")).select("row", "c.*")

    fitted = reliabilities(each.select("kind", "v"), iterations)
    posterior = {(r["kind"], tuple(r["v"])): r["posterior"] for r in fitted.collect()}  # 27 patterns for each kind at most
    if posterior:
        scored = each.withColumn("q", _lookup(F.concat_ws("|", "kind", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")), {f"{k}|{','.join(map(str, v))}": q for (k, v), q in posterior.items()}, 0.5))
        for name, value in _features().items():
            scored = scored.withColumn(f"f_{name}", value)
        soft = scored.select("q", F.explode(F.array(*[F.concat(F.lit(f"{n}:"), F.col(f"f_{n}")) for n in _features()])).alias("feature")).groupBy("feature").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
        mass = scored.agg(F.sum("q"), F.sum(1 - F.col("q"))).first()
        prior = (mass[0] + 1) / (mass[1] + 1)
        # features take a bounded number of values: kinds times votes, length classes or neighbours
        weight = {r["feature"]: ((r["yes"] + 1) / (mass[0] + 2)) / ((r["no"] + 1) / (mass[1] + 2)) for r in soft.collect()}
        odds = F.lit(float(prior))
        for n in _features():
            odds = odds * _lookup(F.concat(F.lit(f"{n}:"), F.col(f"f_{n}")), weight, 1.0)
        judged = scored.withColumn("p", F.round(odds / (1 + odds), 9))
    else:
        judged = each.withColumn("p", F.lit(0.5))
    grouped = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "p"))).alias("found"))
    out = rows.select("row", "doc_id").join(grouped, "row", "left")
    found = F.coalesce("found", F.expr("cast(array() as array<struct<start:long,rank:int,kind:string,end:long,p:double>>)"))
    out = out.select("doc_id", found.alias("found")).withColumn("base", F.filter("found", lambda c: c["rank"] < 4))
    inside = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    out = out.withColumn("added", F.filter("found", lambda c: (c["rank"] >= 4) & (c["p"] >= threshold) & ~inside(c)))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[count(k) for k in KINDS[:4]],
        F.sha2(sp.digest_text(F.col("base")), 256).alias("base_sha256"),
        sp.digest_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.array_max(F.transform("found", lambda c: c["p"])).alias("top_probability"),
    )


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    """The value of a key in a bounded table of fitted parameters."""
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)
