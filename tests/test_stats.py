"""Tail probabilities against published table values and direct sums."""

import math

import pytest

from barloom.functions import pvalues as p


def test_t_tail():
    assert p.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert p.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert p.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("k,n,q", [(3, 10, 0.5), (60, 100, 0.5), (1, 7, 0.2), (0, 5, 0.3)])
def test_binomial_tail(k, n, q):
    want = sum(math.comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k, n + 1))
    assert p.binom_upper(k, n, q) == pytest.approx(want, rel=1e-10)
