"""The network of op8: each exponential is taken once, and outputs of any size keep their probabilities."""

import numpy as np
import pytest

from wardline.llm import lm_scoring


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_network(monkeypatch, scale):
    rng = np.random.default_rng(4)
    vocabulary = lm_scoring.Vocabulary.build([(b"a", 5), (b"b", 3), (b"c", 2)], 12)
    p = lm_scoring.start(vocabulary)
    p["w2"] = (scale * rng.standard_normal(p["w2"].shape)).astype(np.float32)
    ids = rng.integers(0, 3, 50).astype(np.uint16)
    ((near, own),) = lm_scoring.around(ids)
    x = p["e"].astype(float)[near].reshape(len(near), -1)
    out = np.tanh(x @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    out -= out.max(axis=1, keepdims=True)
    expected = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    got = lm_scoring.log_probs(p, vocabulary, near, own) - vocabulary.within[own]
    assert np.allclose(got, expected[np.arange(50), vocabulary.class_of[own]], rtol=1e-4, atol=1e-4 * scale)

    shapes, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda a, *args, **more: shapes.append(np.shape(a)) or exp(a, *args, **more))
    total = {k: np.zeros(s[::-1] if k == "e" else s) for k, s in lm_scoring.SHAPES.items()}
    lm_scoring.add_gradient(p, near, vocabulary.class_of[own], total)
    assert shapes.count((50, lm_scoring.CLASSES)) == 1 and all(np.isfinite(t).all() for t in total.values())
