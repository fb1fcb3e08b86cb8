import numpy as np
import pytest

from mechpairs.llm import ngram_join as N


@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_share_what_they_state(num):
    rng, bands = np.random.default_rng(5), N.Bands(num, 100)
    for n in [*range(7, 60), 100, 333, 1000, 4000]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = int(rng.integers(0, max(1, n - -(-num * n // 100)) + 1))
            new = int(rng.integers(0, max(1, (n - gone) * 100 // num - n + 1)))
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common < num * (len(a) + len(b) - common) or (len(a) == len(b) == common):
                continue
            (sa, na), (sb, nb) = N.signatures(a, bands), N.signatures(b, bands)
            shared = np.intersect1d(sa, sb)
            assert len(shared)
            for sigs, least in ((sa, na), (sb, nb)):
                kind = sigs & np.uint64(3)
                first = {c: least[kind == c].max() for c in set(kind.tolist()) if c % 2 == 0}
                assert any((shared & np.uint64(3) == c).sum() >= need for c, need in first.items())
