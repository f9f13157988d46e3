"""The chain's probabilities and verdicts of op5 for every document, by a loop over its words with the trained weights."""

import re
from math import exp, log1p

import numpy as np
import pytest

from fieldmosaic.llm import toxicity
from fieldmosaic.llm.common import mix, range_hashes, table

SF = "/root/testdata/sf0.001"


def bucket(word):
    data = np.frombuffer(word, np.uint8)
    return int(mix(range_hashes(data, np.array([0]), np.array([len(word)])))[0] % np.uint64(toxicity.BUCKETS))


def probabilities(chain, text):
    data = (text or "").encode()
    if not data:
        return [0.0] * len(chain.categories)
    words = {bucket(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+", data.lower())}
    marks = re.findall(rb"[\x00-\x1f!-@\[-`{-\x7f]", data)
    dense = [sum(65 <= c <= 90 for c in data) / len(data), len(marks) / len(data), log1p(len(data)) / 10]
    out = []
    for m in chain.models:
        margin = m.bias + sum(m.words[w] for w in words) + sum(a * b for a, b in zip(m.dense, dense + out, strict=True))
        out.append(1 / (1 + exp(-max(-30.0, min(30.0, margin)))))
    return out


def test_query_by_a_loop(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, SF, "labels"))
    assert chain.categories == ("junk", "toxic") and len(chain.models[1].dense) == len(chain.models[0].dense) + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op5_toxicity_chain(spark, SF).collect()
    assert len(got) == len(texts) == len({r.doc_id for r in got})
    for r in got:
        want = probabilities(chain, texts[r.doc_id])
        assert (r.p_junk, r.p_toxic) == pytest.approx(tuple(want), abs=1e-9)
        assert (r.junk, r.toxic) == tuple(bool(r[f"p_{c}"] > t) for c, t in zip(chain.categories, chain.thresholds, strict=True))
    assert 0 < sum(r.toxic for r in got) < len(got) / 2


def test_odd_texts_by_a_loop(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, SF, "labels"))
    odd = ["", None, "   ", "!!!", "A", "ÉÉ éé 12", "x" * 300_000, "one\ttwo\nONE", "a-b-c " * 2000, "\x00\x7f~"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in toxicity.score(df, chain).collect():
        assert (r.p_junk, r.p_toxic) == pytest.approx(tuple(probabilities(chain, odd[r.doc_id])), abs=1e-9), odd[r.doc_id]
