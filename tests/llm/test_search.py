"""The search of near-dedup inside a candidate component."""

import numpy as np
import pytest

from tessera.llm import near_dedup

BANDS, ROWS = 32, 5
DIFFER = BANDS * ROWS - near_dedup.least_common(BANDS * ROWS, 80)


def _signs(sets):
    rng = np.random.default_rng(5)
    mul = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    keys, signs = np.zeros((len(sets), BANDS), dtype=np.uint64), np.zeros((len(sets), 3), dtype=np.uint64)
    near_dedup._minima(np.concatenate(sets), np.cumsum(sizes) - sizes, mul, add, BANDS, ROWS, keys, signs, np.arange(len(sets)))
    return signs


def _components(n, links):
    top = list(range(n))
    for a, b in links:
        top = [top[b] if t == top[a] else t for t in top]
    return [top.index(t) for t in top]


@pytest.mark.parametrize("seed", range(20))
def test_search_finds_what_all_pairs_give(seed):
    rng = np.random.default_rng(seed)
    pool, sets = rng.integers(0, 1 << 63, 400, dtype=np.uint64), []
    for _ in range(60):
        s = rng.choice(pool, rng.integers(1, 120))
        if sets and rng.random() < 0.6:
            s = sets[rng.integers(len(sets))]
            s = np.concatenate((s[rng.random(len(s)) > 0.1], rng.choice(pool, rng.integers(1, 2 + len(s) // 10))))
        sets.append(np.unique(s))
    ids, found = rng.permutation(len(sets)), []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                found.append((ids[i], ids[j]))
    assert len(found) > 5
    got = near_dedup.reach(ids, sets, _signs(sets), 80, DIFFER)
    assert _components(len(sets), got) == _components(len(sets), found)


def test_bits_allow_similar_pairs():
    """Of 3000 pairs of similarity exactly 0.8 none is taken for less similar; most of those at 0.2 are."""
    rng = np.random.default_rng(1)
    one = lambda n, own: [(x[: n + own], np.concatenate((x[:n], x[n + own :]))) for x in rng.integers(0, 1 << 63, (3000, n + 2 * own), dtype=np.uint64)]
    for pairs, share in ((one(8, 1), 1), (one(80, 10), 1), (one(20, 40), 0)):
        a, b = (_signs([p[k] for p in pairs]) for k in (0, 1))
        assert abs((np.bitwise_count(a ^ b).sum(axis=1) <= DIFFER).mean() - share) < 0.01 * (1 - share) + 1e-9


def test_members_that_share_a_line_are_not_all_compared(monkeypatch):
    """Short texts with a common line and hardly a link: sets are compared where size and bits allow one."""
    compared, plain = [], near_dedup._Open.common
    monkeypatch.setattr(near_dedup._Open, "common", lambda self, rows, marks: compared.append(len(rows)) or plain(self, rows, marks))
    rng, line = np.random.default_rng(2), np.arange(1, 13, dtype=np.uint64) << np.uint64(40)
    sets = [np.sort(np.concatenate((line, rng.integers(0, 1 << 63, n, dtype=np.uint64)))) for n in rng.integers(10, 40, 3000)]
    sets += [s[:-1] for s in sets[:50]]
    links = near_dedup.reach(np.arange(len(sets)), sets, _signs(sets), 80, DIFFER)
    assert sorted(links) == [(3000 + i, i) for i in range(50)]
    assert sum(compared) < 0.01 * len(sets) ** 2 / 2
