import hashlib
import random
from collections import Counter

import pytest

from sealedspark import vectors


@pytest.mark.parametrize("dim", [32, 768])
def test_words_are_counted_where_their_document_is(spark, dim):
    """Repeated and null doc_ids count together; texts are shuffled once, words never."""
    rnd = random.Random(dim)
    docs = [(i % 40 if i % 9 else None, " ".join(rnd.choices(["a", "B", "b", "éa", "x1", " ", "long-word"], k=rnd.randint(0, 30)))) for i in range(120)] + [(1, None)]
    want = Counter((d, int(hashlib.md5(w.encode()).hexdigest(), 16) % dim) for d, t in docs if t for w in t.lower().split())
    got = vectors.hash_embed(spark.createDataFrame(docs, "doc_id long, text string"), dim)
    assert {(r.doc_id, r.bucket): r.n for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
