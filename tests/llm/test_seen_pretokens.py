"""Pre-tokens that a task has passed on before."""

import numpy as np

from saccadia.llm import token_counts


def test_seen_hashes_are_searched_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(4)
    seen, keys = (np.unique(rng.integers(0, 5000, n).astype(np.uint64)) for n in (900, 700))
    monkeypatch.setattr(np, "isin", None)
    assert token_counts._among(seen, keys).tolist() == [k in set(seen.tolist()) for k in keys.tolist()]
    assert not token_counts._among(np.zeros(0, np.uint64), keys).any()
    assert not token_counts._among(seen, np.zeros(0, np.uint64)).any()
