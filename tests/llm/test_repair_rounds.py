"""Re-Pair goes on until no pair is frequent or the symbols no longer fit 16 bits."""

from __future__ import annotations

import numpy as np

from tidemark.llm import tokenstore


def test_long_copied_passages_become_few_symbols():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 50_000, 256)
    docs = [np.concatenate([rng.integers(0, 50_000, 5), passage]).astype("<u4") for _ in range(40)]
    shard = tokenstore._shard(0, 0, list(range(40)), docs, 50_257, None)
    symbols, ends, _, lengths = tokenstore.repair(np.concatenate(docs), np.cumsum([len(d) for d in docs]), 50_257)
    assert lengths.max() >= 128 and len(symbols) < 40 * 12
    assert all((tokenstore.read_ids(shard, j) == d).all() for j, d in enumerate(docs))
    pairs = [(a, b) for i, e in enumerate(ends) for a, b in zip(symbols[ends[i - 1] if i else 0 : e], symbols[(ends[i - 1] if i else 0) + 1 : e])]
    assert max(map(pairs.count, set(pairs)), default=0) < tokenstore.LEAST_COUNT
