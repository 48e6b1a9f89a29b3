"""The classifier's forward pass against plain loops."""

import numpy as np

from relgen.llm import toxicity


def plain(model, rows):
    x = [model.emb[r].astype(float) for r in rows]
    out, at = float(model.out_bias), 0
    for w in model.conv:
        for f in range(w.shape[2]):
            found = [0.0]
            for p in range(len(x)):
                found.append(sum(float(x[p + j] @ w[j, :, f]) for j in range(len(w)) if p + j < len(x)))
            out += max(max(found) + float(model.bias[at]), 0.0) * float(model.out[at])
            at += 1
    return out


def test_scores_are_those_of_plain_loops_and_of_the_text_alone():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n) for n in [0, 1, 2, 3, *rng.integers(0, 30, 60)]]
    model = toxicity.train(texts, np.arange(64) % 2, epochs=2)
    together = toxicity.logits(model, texts)
    assert np.allclose(together, [toxicity.logits(model, [t])[0] for t in texts], atol=1e-5)
    assert np.allclose(together, toxicity.logits(model, texts[::-1])[::-1], atol=1e-5)
    assert np.allclose(together, [plain(model, model.row[t]) for t in texts], atol=1e-4)
