"""Tail probabilities against known values."""

import math

import pytest

from plumbline.functions import tails


@pytest.mark.parametrize("x, dof, expected", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
                                              (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1))])
def test_chi_square(x, dof, expected):
    assert tails.gamma_upper(dof / 2, x / 2) == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("t, dof, expected", [(12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05),
                                              (1.9623390808264078, 1000, 0.05), (0.0, 5, 1.0)])
def test_student_t(t, dof, expected):
    assert tails.t_two_sided(t, dof) == pytest.approx(expected, rel=1e-8)


def test_normal_and_kolmogorov():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert tails.kolmogorov_upper(1.3580986393225505) == pytest.approx(0.05, rel=1e-6)
    assert tails.kolmogorov_upper(0.0) == 1.0
    assert tails.beta_lower(2, 3, 0.4) == pytest.approx(0.5248, rel=1e-9)


@pytest.mark.parametrize("x", [1e6, 1e6 + 50, 1e6 + 2000, 1e6 - 1500, 1.005e6])
def test_expansions_for_large_arguments_agree_with_the_sums(monkeypatch, x):
    large, t = tails.gamma_upper(1e6, x), tails.t_two_sided(2.0, 1e6)
    monkeypatch.setattr(tails, "LARGE", 1e99)
    assert large == pytest.approx(tails.gamma_upper(1e6, x), rel=1e-5, abs=1e-9)
    assert t == pytest.approx(tails.t_two_sided(2.0, 1e6), rel=1e-8)


def test_student_t_with_very_many_degrees_of_freedom():
    assert tails.t_two_sided(2.0, 1e12) == pytest.approx(0.0455002638963584, rel=1e-9)
