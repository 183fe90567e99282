"""Personal data in texts by weak supervision, with built-in functions only.

Loose patterns propose candidate spans. Labelers vote on each, yes, no or nothing: the strict form of the kind, a
check of its numbers (parts, checksum, lengths), a gazetteer of top-level domains and calling codes, cue words before
it, signs of another meaning (version, reference, order), and whether it stands alone. Votes are grouped by kind and
pattern of votes, at most 3^6 of each kind, and expectation-maximisation over those counts estimates how reliable each
labeler is on each kind. The posteriors weigh every candidate in training the final classifier, a naive Bayes model of
each kind over features of the span and its surroundings whose counts are one grouped sum over all candidates. A
candidate is a span if its score is at least `accept`, or if it is of a fixed kind that passes that kind's rules: those
always stay. A number that fails the cards' checksum is no card, whatever its score; it still counts in the estimates.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, distinct_ids
from .spans import counted, digest, located

KINDS = ["email", "ip", "card", "phone", "email_like", "ip_like", "card_like", "phone_like", "ssn_like"]
BASE = 4
#: Possessive repeats and look-behinds find what the plain patterns find, in time linear in the text and without deep
#: recursion: a match can only begin where a run of its first characters begins, or where the match before it ended.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])",
    r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
]
#: The kind that each loose kind resembles, for labelers and features.
AS_BASE = [0, 1, 2, 3, 0, 1, 2, 3, 3]
DOMAINS = "com org net edu gov io de fr es uk eu info".split()
CALLING_CODES = "1 33 34 44 49".split()
#: A cue, or a sign of another meaning, counts within so many characters before the span.
CUES = {
    0: r"(?i)\b(e-?mail|mail|contact|correo|courriel|kontakt|write)\b[^\n]{0,16}$",
    1: r"(?i)\b(ip|host|server|address|addr|adresse|login|from)\b[^\n]{0,16}$",
    2: r"(?i)\b(card|visa|mastercard|amex|tarjeta|carte|karte|paid)\b[^\n]{0,16}$",
    3: r"(?i)\b(phone|tel|call|mobile|fax|telefon|telefono|ssn|social)\b[^\n]{0,16}$",
}
AGAINST = r"(?i)\b(version|release|section|chapter|isbn|ref|order|invoice|part|item|v)\b[^\n]{0,8}$"
LABELERS = ["strict", "numbers", "gazetteer", "cue", "other_meaning", "alone"]
ROUNDS, ACCEPT, PRIOR = 30, 0.5, 0.5
BROADCAST = 1_000_000  # spans at most to send to every task


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def one(i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def parts_at_most_255(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("0").try_cast("int") <= 255))


def follows_rules(kind: Column, match: Column) -> Column:
    """The fixed rules of the four base kinds; false for the loose ones."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    card = F.when(n.between(16, 19), luhn(F.when(n.between(16, 19), digits).otherwise("0"))).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, parts_at_most_255(match)).when(kind == 2, card).when(kind == 3, n.between(8, 15)).otherwise(False)


def votes(found: DataFrame) -> DataFrame:
    """Adds votes, one of 1, 0, -1 (yes, nothing, no) per labeler, to candidates with base (fixed kind and rules kept) and
    checked (no card, or one whose digits pass the checksum)."""
    k, m = F.col("kind"), F.col("match")
    like = F.get(F.array(*[F.lit(x) for x in AS_BASE]), k)
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    tail = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    strict = F.when(k < BASE, F.when(F.col("base"), 1).otherwise(-1)).otherwise(0)
    numbers = F.when(k == 6, F.when(F.col("checked"), 1).otherwise(-1)).when(k == 7, F.when(digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"), 1).otherwise(-1)).when(k == 8, F.when(m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1).otherwise(-1)).when(k == 1, F.when(m.rlike(r"^0|\.0[0-9]"), -1).otherwise(1)).when(k == 2, F.when(~F.col("checked"), -1).when(n.between(16, 19), 1).otherwise(0)).when(k == 3, F.when(n.between(10, 13), 1).otherwise(0)).otherwise(0)
    gazetteer = F.when(like == 0, F.when(tail.isin(DOMAINS), 1).otherwise(-1)).when(k == 3, F.when(m.rlike(r"^\+(%s)(?![0-9]{12})" % "|".join(CALLING_CODES)), 1).otherwise(-1)).otherwise(0)
    cue = F.lit(0)
    for c, p in CUES.items():
        cue = F.when((like == c) & F.col("left").rlike(p), 1).otherwise(cue)
    other = F.when(F.col("left").rlike(AGAINST), -1).otherwise(0)
    alone = F.when(F.col("left").rlike(r"(^|[\s(:,;=\"'|])$") & F.col("right").rlike(r"^($|[\s).,;:!?\"'|])"), 0).otherwise(-1)
    return found.withColumn("votes", F.array(*[x.cast("int") for x in (strict, numbers, gazetteer, cue, other, alone)]))


def features() -> list[tuple[str, Column]]:
    """Yes-or-no features of a candidate for the final classifier."""
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    vote = lambda name, v: F.get("votes", F.lit(LABELERS.index(name))) == v
    return [
        ("rules", F.col("base")), ("short", F.length(m) <= 8), ("long", F.length(m) >= 25),
        ("space_before", left.rlike(r"(^|\s)$")), ("space_after", right.rlike(r"^(\s|$|[.,;])")),
        ("cue", vote("cue", 1)), ("other_meaning", vote("other_meaning", -1)), ("gazetteer", vote("gazetteer", 1)), ("numbers", vote("numbers", 1)), ("apart", vote("alone", -1)),
    ]


#: Counts of (no, nothing, yes) that each labeler starts with, for true and for false candidates: better than chance.
TRUE, FALSE = (1.0, 4.0, 4.0), (4.0, 4.0, 1.0)


def expectation_maximisation(patterns: list[tuple[int, tuple, int]], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """patterns: (kind, votes, count). Returns the posterior of each (kind, votes), and for each (kind, labeler) the shares of
    its votes (no, nothing, yes) among true and among false candidates. Runs on grouped counts only."""
    share = {k: PRIOR for k, _, _ in patterns}
    said = {(k, j): (tuple(x / sum(TRUE) for x in TRUE), tuple(x / sum(FALSE) for x in FALSE)) for k in share for j in range(len(LABELERS))}
    post: dict = {}
    for _ in range(rounds):
        for k, v, _ in patterns:
            odds = math.log(share[k] / (1 - share[k])) + sum(math.log(said[k, j][0][x + 1] / said[k, j][1][x + 1]) for j, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(min(700.0, max(-700.0, -odds))))
        for k in share:
            own = [(v, c, post[k, v]) for q, v, c in patterns if q == k]
            n, t = sum(c for _, c, _ in own), sum(c * p for _, c, p in own)
            share[k] = (t + 1) / (n + 2)
            for j in range(len(LABELERS)):
                yes = [TRUE[x + 1] + sum(c * p for v, c, p in own if v[j] == x) for x in (-1, 0, 1)]
                no = [FALSE[x + 1] + sum(c * (1 - p) for v, c, p in own if v[j] == x) for x in (-1, 0, 1)]
                said[k, j] = tuple(x / sum(yes) for x in yes), tuple(x / sum(no) for x in no)
    return post, said


def trained_score(candidates: DataFrame) -> tuple[Column, dict]:
    """The final classifier as a column over candidates with kind, votes, match, left, right, base."""
    grouped = candidates.groupBy("kind", "votes").count().collect()  # at most kinds x 3^labelers rows
    post, said = expectation_maximisation([(r["kind"], tuple(r["votes"]), r["count"]) for r in grouped])
    if not post:
        return F.lit(0.0), said
    key = F.concat_ws(",", F.col("kind").cast("string"), F.array_join(F.transform("votes", lambda v: v.cast("string")), ","))
    table = F.create_map(*[F.lit(x) for (k, v), p in post.items() for x in (",".join(map(str, (k, *v))), float(p))])
    named = features()
    q = candidates.withColumn("p", F.coalesce(table[key], F.lit(PRIOR)))
    sums = q.groupBy("kind").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"), *[F.sum(F.when(c, F.col("p")).otherwise(0.0)).alias(f"t_{n}") for n, c in named], *[F.sum(F.when(c, 1 - F.col("p")).otherwise(0.0)).alias(f"f_{n}") for n, c in named]).collect()
    of_kind = lambda weights: F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)])[F.col("kind")]
    score = of_kind({r["kind"]: math.log((r["t"] + 1) / (r["f"] + 1)) for r in sums})
    for n, c in named:
        a = {r["kind"]: (r[f"t_{n}"] + 1) / (r["t"] + 2) for r in sums}
        b = {r["kind"]: (r[f"f_{n}"] + 1) / (r["f"] + 2) for r in sums}
        score = score + F.when(c, of_kind({k: math.log(a[k] / b[k]) for k in a})).otherwise(of_kind({k: math.log((1 - a[k]) / (1 - b[k])) for k in a}))
    return 1 / (1 + F.exp(-score)), said


def personal_data(docs: DataFrame, accept: float = ACCEPT, **columns) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (arrays of kind, start, end, ordered by kind, start; kinds index KINDS).

    base are the spans of the four fixed kinds that keep their rules. spans has them and the candidates the classifier
    accepts that overlap none of them. Null and empty texts have none. Rows that repeat a doc_id are scanned one by
    one; other columns are ignored. The candidates are written once to the shared folder: training and
    the result read that table, not the texts.
    """
    found = located(docs, PATTERNS, before=32, after=4, **columns)
    m, k = F.col("match"), F.col("kind")
    plausible = (k != 2) | F.length(F.regexp_replace(m, "[^0-9]", "")).between(13, 19)  # other numbers are never cards
    found = found.where(plausible).withColumn("base", F.coalesce(follows_rules(k, m), F.lit(False)))
    digits = F.regexp_replace(m, "[^0-9]", "")
    found = found.withColumn("checked", ~k.isin(2, 6) | luhn(F.when(k.isin(2, 6), digits).otherwise("0")))
    found = cut(votes(found), "candidates")
    candidates = found.where("kind >= 0")
    score, _ = trained_score(candidates)
    span = F.struct("kind", "start", "end")
    scored = found.withColumn("more", (F.col("kind") >= 0) & ~F.col("base") & F.col("checked") & (score >= accept))
    of = scored.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.collect_list(F.when(F.col("more"), span)).alias("more"))
    added = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return of.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with every span of personal data in the text replaced by its kind in brackets; the columns as they were.

    Overlapping spans are replaced together under the first one's kind. Spans go back to the row they were found in: where
    ids are null or repeat, rows are numbered in a table first. Null texts stay null; an empty table stays empty.
    """
    key, held, columns = doc_id, f"spans_{uuid.uuid4().hex[:8]}", docs.columns
    named = docs.select(F.col(doc_id).alias("doc_id"))
    if not named.where("doc_id is null").isEmpty() or not distinct_ids(named):
        key = f"row_{uuid.uuid4().hex[:8]}"
        docs = cut(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    hit = personal_data(docs, doc_id=key, text=text, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias(held))
    hit = cut(hit, "spans")
    few = (hit.agg(F.sum(F.size(held) + 1)).first()[0] or 0) <= BROADCAST
    joined = docs.join(F.broadcast(hit) if few else hit, key, "left")
    labels = F.array(*[F.lit(n) for n in KINDS])
    ordered = F.array_sort(F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    t = F.col(text)
    state = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.when(s["start"] < a["to"], F.struct(a["done"].alias("done"), F.greatest(a["to"], s["end"]).alias("to"))).otherwise(
            F.struct(F.concat(a["done"], F.substr(t, (a["to"] + 1).cast("int"), (s["start"] - a["to"]).cast("int")), F.lit("["), F.get(labels, s["kind"]), F.lit("]")).alias("done"), s["end"].alias("to"))
        ),
    )
    new = F.when(F.col(held).isNull(), t).otherwise(F.concat(state["done"], F.substr(t, (state["to"] + 1).cast("int"), F.length(t))))
    return joined.withColumn(text, new).select(*columns)


def op10_personal(spark, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [counted("base", k).alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE])]
    return out.select("doc_id", *count, F.sha2(digest(KINDS, F.col("base")), 256).alias("base_sha256"), digest(KINDS, F.col("spans")).alias("spans"))
