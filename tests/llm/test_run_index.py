"""The index's order of suffixes: against sorting them as they are, and in how many sorts."""

import numpy as np
import pytest

from starcard.llm import run_index
from starcard.llm.run_index import RunIndex


@pytest.mark.parametrize("seed", range(8))
def test_order_and_intervals(seed):
    rng = np.random.default_rng(seed)
    depth, texts = int(rng.integers(17, 60)), {b"a" * 70, b"a" * 64, b"a" * 72, b"ab" * 32}
    base = rng.integers(97, 99, 300).astype(np.uint8)
    for _ in range(40):
        size = int(rng.integers(depth, depth + 63))
        at = int(rng.integers(0, 300 - size))
        texts.add(base[at : at + size].tobytes())
    strings = sorted(texts, key=lambda s: hash(s) ^ seed)
    index = RunIndex(strings, np.arange(len(strings), dtype=np.uint64), depth)
    suffixes = sorted((s[i:], n, i) for n, s in enumerate(strings) for i in range(len(s) + 1))
    heads = [1] + [int(len(a[0]) < depth or a[0][:depth] != b[0][:depth]) for a, b in zip(suffixes[1:], suffixes, strict=False)]
    assert index.interval.tolist() == (np.cumsum(heads) - 1).tolist()
    place = {(n, i): row for row, (_, n, i) in enumerate(suffixes)}
    steps = index.steps()
    assert all(steps[place[n, i]] == place[n, i - 1] for _, n, i in suffixes if i)


def test_sorts_grow_with_the_logarithm_of_what_is_shared(monkeypatch):
    """Contexts that share all but their ends are sorted by twice as many bytes each time, not by eight more."""
    sorts = []
    for name in ("argsort", "lexsort"):
        plain = getattr(np, name)
        monkeypatch.setattr(run_index.np, name, lambda *a, _plain=plain, **k: sorts.append(1) or _plain(*a, **k))
    RunIndex([b"x" * 100 + bytes([c]) * 12 for c in range(97, 110)], np.arange(13, dtype=np.uint64), 50)
    assert len(sorts) <= 6
