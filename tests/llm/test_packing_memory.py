"""What packing holds beside a shard's tokens, and what its workers keep."""

import tracemalloc

import numpy as np
import public_tokenizers

from fieldmosaic.llm import packing


def _peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tokens_are_not_copied_whole():
    rng = np.random.default_rng(1)
    held = [rng.integers(0, 300, 20_000).astype("<u2") for _ in range(100)]  # 2,000,000 tokens, 30,000 pairs of a document and a term
    stats = packing.Stats.of(held)
    assert _peak(lambda: packing.Index(held, stats)) < 4 * sum(map(len, held))


def test_weights_are_those_of_counts():
    rng = np.random.default_rng(2)
    held = [rng.integers(0, 60_000, int(n)).astype("<u2") % rng.integers(1, 60_000) for n in rng.integers(1, 300, 80)] + [np.array([50_000], "<u2")]
    stats = packing.Stats.of(held)
    index = packing.Index(held, stats)
    for k in (0, 17, 80):
        want = [sum(float(stats.weight(t, int((d == t).sum()), len(d))) for t in set(held[k].tolist()) & set(d.tolist())) for d in held]
        other = np.arange(len(held)) != k  # a seed's own score leaves out terms that it has alone
        np.testing.assert_allclose(index.scores(k)[other], np.array(want)[other], rtol=1e-5)
    assert stats.places(held)[:, 80].tolist() == [50_000, 50_000]
    assert packing._places(stats, packing.pa.array([held[80].tobytes()]))[0] // packing.GROUPS == 50_000  # not cut to 16 bits


def test_later_steps_drop_the_encoder():
    packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    list(packing._term_counts(iter([])))
    assert packing.encoder.cache_info().currsize == 0
