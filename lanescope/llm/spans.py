"""Positions of regular-expression matches with built-in functions only.

Spark has no function that returns the positions of all matches, but split() returns the gaps between them and
regexp_extract_all() the matches, in the same order; running sums of their lengths are the positions. Both scan with
the same matcher, so the two always agree. The sums are a window over one document's matches of one kind, so a text
with very many matches costs a sort, not a task that holds them all. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pieces(text: Column, kind: int, pattern: str, before: int = 0, after: int = 0) -> Column:
    """array<struct<kind, i, gap, match, left, right>>: the matches of one kind in order with the length of the gap
    before each and the last `before` and first `after` code points around it. Empty where nothing matches."""
    p = F.lit(pattern)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))

    def one(g: Column, i: Column) -> Column:
        nothing = F.lit("")
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(g).alias("gap"), F.get(found, i).alias("match"),
            (F.right(g, F.lit(before)) if before else nothing).alias("left"),
            (F.substring(F.coalesce(F.get(gaps, i + 1), nothing), 1, after) if after else nothing).alias("right"),
        )

    each = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), one)
    return F.when(text.rlike(pattern), each)


def located(docs: DataFrame, patterns: list[str], doc_id: str = "doc_id", text: str = "text", before: int = 0, after: int = 0) -> DataFrame:
    """(row, doc_id, kind, i, match, left, right, start, end) for every match, kind being the pattern's index from 0,
    and one row with kind -1 for every input row. Text isn't carried. Null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.monotonically_increasing_id().alias("row"))
    kinds = [F.coalesce(pieces(F.col("t"), k, p, before, after), F.array().cast(SPAN)) for k, p in enumerate(patterns)]
    own = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("match"), F.lit("").alias("left"), F.lit("").alias("right"))).cast(SPAN)
    each = base.select("row", "doc_id", F.explode(F.concat(own, *kinds)).alias("m")).select("row", "doc_id", "m.*")
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("match")
    end = F.sum(F.col("gap") + size).over(w)
    return each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - size).drop("gap")


SPAN = "array<struct<kind:int,i:int,gap:int,match:string,left:string,right:string>>"


def digest(names: list[str], spans: Column) -> Column:
    """kind:start:end, comma-joined, of an ordered array of structs with kind, start, end."""
    labels = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(labels, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column | str, kind: int) -> Column:
    """How many of an array of structs with kind are of a kind. The lambda takes one argument: filter() hands a second one the index."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
