"""Whole queries against the libraries, held-out labels and kinds that a model has not seen."""

import math
import zlib

import numpy as np

from docloom.llm import secrets
from docloom.llm.common import read, tokenizer_path
from docloom.llm.queries import op6_token_counts, op9_toxicity


def test_token_counts_of_a_whole_table(spark, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = dict(read(spark, small, "documents").select("doc_id", "text").collect())
    want = {k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in texts.items()}
    got = {r.doc_id: r for r in op6_token_counts(spark, small).collect()}
    assert {k: (r.n_bytes, r.n_tokens) for k, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values()) and any(r.over_limit for r in got.values())


def test_toxicity_of_a_whole_table_on_labels_it_has_not_seen(spark, small):
    where = small.replace("sf0.001", "sf0.1")  # the smaller tables hold a handful of toxic documents only
    rows = {r.doc_id: r for r in op9_toxicity(spark, where).collect()}
    labels = {r.doc_id: r.toxic for r in read(spark, where, "labels").collect()}
    assert set(rows) == {r.doc_id for r in read(spark, where, "documents").select("doc_id").collect()}
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and not math.isnan(r.score) and r.predicted == int(r.score >= 0.7)
    unseen = [(labels[k], r.predicted) for k, r in rows.items() if r.held_out and k in labels]
    toxic = [p for t, p in unseen if t]
    clean = [p for t, p in unseen if not t]
    assert len(unseen) > 30 and np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.05


#: Kinds of made findings in their order: seven of secrets, six of look-alikes.
KINDS = ["letters and digits", "marks", "long", "letters", "address", "vendor", "key block", "mail", "path", "address of a machine", "number", "time", "checksum"]


def test_kinds_of_secrets_that_the_forest_has_not_seen(spark):
    """Each kind is held out of training once; recall by kind, and precision against the look-alikes, of what is left to the other kinds."""
    made = secrets.made_findings(60)
    kind = [k % len(KINDS) for k in range(len(made))]
    dictionary = frozenset(["total", "invoice", "commit"])
    found = {}
    for held in range(len(KINDS)):
        rest = [m for m, k in zip(made, kind, strict=True) if k != held]
        forest = secrets.train(spark.createDataFrame(rest, "value string, before string, after string, path string, label int"), dictionary)
        x = np.array([secrets.describe(*m[:4], dictionary) for m, k in zip(made, kind, strict=True) if k == held])
        found[KINDS[held]] = float(np.mean(forest.vote(x) >= secrets.THRESHOLD))
    recall, wrong = [found[k] for k in KINDS[:7]], [found[k] for k in KINDS[7:]]
    print({k: round(v, 2) for k, v in found.items()})
    assert np.mean(recall) >= 0.6, found
    assert np.mean(wrong) <= 0.4, found
