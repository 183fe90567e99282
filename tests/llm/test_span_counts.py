"""The columns that the contract fixes, of the queries themselves, against plain patterns."""

import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
from test_spans import TRICKY

from lanescope.llm import personal, secrets


def written(spark, folder):
    texts = [*TRICKY, "4111111111111111 +49 30 1234567", "1.2.3.4 and 5.6.7.8, a@b.c", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return texts


def want(spans, kinds):
    spelled = ",".join("%s:%d:%d" % s for s in spans)
    return (*[sum(s[0] == k for s in spans) for k in kinds], hashlib.sha256(spelled.encode()).hexdigest())


def test_personal_counts_each_kind(spark, tmp_path):
    texts, kinds = written(spark, tmp_path), personal.KINDS[: personal.BASE]
    got = {r["doc_id"]: tuple(r)[1 : len(kinds) + 2] for r in personal.op10_personal(spark, str(tmp_path)).collect()}
    plain = [sorted(brute.personal(t), key=lambda s: (kinds.index(s[0]), s[1])) for t in texts]
    assert got == {i: want(p, kinds) for i, p in enumerate(plain)}


def test_secrets_count_each_kind(spark, tmp_path):
    texts, kinds = written(spark, tmp_path), secrets.KINDS[:3]
    got = {r["doc_id"]: tuple(r)[1 : len(kinds) + 2] for r in secrets.op7_secrets(spark, str(tmp_path)).collect()}
    assert got == {i: want(brute.secrets(t), kinds) for i, t in enumerate(texts)}
