"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams by language are summed by Spark over a bounded sample of labelled documents
(`max_train`, taken evenly by a hash of doc_id), the log-probability matrix (languages x buckets) is broadcast, and
whole texts are scored in numpy, a gather and a sum per document and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches
from .textbytes import LOWER, mixed, text_bytes

BUCKETS, MAX_TRAIN, SMOOTH = 1 << 15, 20_000, 0.5
UNKNOWN = "und"
#: Grams that count in full towards the score, not the choice; a longer text is no surer than one of so many.
SURE_AT = 60


def gram_buckets(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position but the last n - 1."""
    h = np.full(len(codes) - n + 1, np.uint64(n))
    for k in range(n):
        h = h * np.uint64(1_000_003) + codes[k : len(codes) - n + 1 + k]
    return (mixed(h) % np.uint64(buckets)).astype(np.int32)


def grams(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 2, 3: (bucket of each n-gram, first n-gram of each text). Texts are set off by line ends, and no n-gram reaches
    into the next text."""
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    ascii_ = codes < 128
    codes = np.where(ascii_, LOWER[np.where(ascii_, codes, 0)], codes).astype(np.uint64)
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    two, three = (gram_buckets(codes, n, buckets) for n in (2, 3))
    over = first + [len(t) for t in texts]  # the n-grams of three that hold the next text's first character
    return [(two[:-1], first), (np.delete(three, over[over < len(three)]), first - np.arange(len(texts)))]


def parts(column: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of stretches with about `limit` bytes."""
    at = text_bytes(column)[1]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probability matrix) of rows with text and language. About max_train rows at most are read.

    Rows with a null text or language teach nothing; rows that repeat count as often as they are taken. Nothing to learn
    from: no languages. Other columns are ignored.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = rows.count()
    if n > max_train:
        rows = rows.where(hashed_share(F.col(doc_id), F.col(text), F.lit("language")) < max_train / n)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, texts in parts(batch.column(1)):
                at: dict[str, list[str]] = {}
                for k, t in enumerate(texts):
                    at.setdefault(langs[lo + k], []).append(t)
                for name, own in at.items():
                    c = sums.setdefault(name, np.zeros(buckets, np.int64))
                    for b, _ in grams(own, buckets):
                        c += np.bincount(b, minlength=buckets)
                    docs[name] = docs.get(name, 0) + len(own)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], docs[name]))], names=["lang", "bucket", "n"])

    sums = modest_batches(rows).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # languages x buckets at most
    langs = sorted(found["lang"].unique())
    matrix = np.full((len(langs), buckets), SMOOTH)
    prior = np.ones(len(langs))
    for k, name in enumerate(langs):
        own = found[found["lang"] == name]
        real = own["bucket"].to_numpy() >= 0
        matrix[k, own["bucket"].to_numpy()[real]] += own["n"].to_numpy()[real]
        prior[k] += own["n"].to_numpy()[~real].sum()
    return langs, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (share of the likeliest language, tempered by length).

    Null text, text without a letter, and any text when nothing was learned: `und` with score 0. Ties go to the
    first language by name. Rows that repeat a doc_id are judged one by one; other columns are ignored.
    """
    langs, prior, matrix = model
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not langs:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((prior, matrix))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = judged(batch.column(1), *shared.value)
            name = pa.array([langs[k] if k >= 0 else UNKNOWN for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), name, pa.array(sure)], names=["doc_id", "lang_pred", "score"])

    return modest_batches(rows).mapInArrow(scored, "doc_id long, lang_pred string, score double")


def judged(column: pa.Array, prior: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language, score) of each text; -1 and 0 where there is no letter."""
    best, sure = np.full(len(column), -1, np.int64), np.zeros(len(column))
    for lo, texts in parts(column):
        texts = [t or "" for t in texts]
        like, n = np.zeros((len(prior), len(texts))), np.zeros(len(texts))
        for b, first in grams(texts, matrix.shape[1]):
            if not len(b):
                continue
            inside = np.minimum(first, len(b) - 1)
            n += np.diff(np.append(inside, len(b)))
            for k in range(len(prior)):
                like[k] += np.add.reduceat(matrix[k][b], inside, dtype=np.float64)
        choice = (like + prior[:, None]).argmax(axis=0)
        like = like * (np.minimum(n, SURE_AT) / np.maximum(n, 1)) + prior[:, None]
        with np.errstate(over="ignore"):
            p = 1 / np.exp(like - like[choice, np.arange(len(texts))]).sum(axis=0)
        letters = np.array([any(map(str.isalpha, t)) for t in texts])
        best[lo : lo + len(texts)] = np.where(letters, choice, -1)
        sure[lo : lo + len(texts)] = np.where(letters, p, 0.0)
    return best, sure


def hashed_share(*columns):
    """A number from 0 to 1, even over distinct rows of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(2**53)


def fold(doc_id, n: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def accepted(docs: DataFrame, model, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows whose language can't be told: `und`, or a score under `least`. Columns stay, and nothing is
    shuffled. A model that could not learn anything rejects nothing. Rows that repeat are judged one by one."""
    langs, prior, matrix = model
    if not langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((prior, matrix))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = judged(batch.column(batch.schema.get_field_index(text)), *shared.value)
            yield batch.filter(pa.array((best >= 0) & (sure >= least)))

    return modest_batches(docs).mapInArrow(kept, docs.schema)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
