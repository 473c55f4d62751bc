import math

import pytest

from isochord.functions.dist import t_two_sided


def normal(t):
    return math.erfc(t / math.sqrt(2))


def second_order(t, df):
    """The normal tail and the first two terms in 1 / df."""
    density = 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    return normal(t) + density * (t * (t * t + 1) / (4 * df)
                                  + (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * df * df))


@pytest.mark.parametrize("t", [0.1, 0.999, 1.0, 1.001, 1.96, 3.0, 10.0, 500.0])
def test_closed_forms_of_few_degrees(t):
    assert t_two_sided(t, 1) == pytest.approx(2 / math.pi * math.atan2(1, t), rel=1e-10)
    assert t_two_sided(t, 2) == pytest.approx(2 / ((2 + t * t) * (1 + t / math.sqrt(2 + t * t))),
                                              rel=1e-10)


@pytest.mark.parametrize("df", [1e5, 6e6, 6e7, 6e8, 6e9, 1e12])
def test_many_degrees_reach_the_normal_tail(df):
    for t in (0.3, 1.0, 1.959963984540054, 4.0):
        assert t_two_sided(t, df) == pytest.approx(second_order(t, df), rel=1e-9)


def test_table_values():
    # critical values of two-sided 5 % (as printed, four digits)
    for df, t in ((3, 3.1824), (10, 2.2281), (30, 2.0423), (120, 1.9799), (199, 1.9720),
                  (201, 1.9718), (1000, 1.9623)):
        assert t_two_sided(t, df) == pytest.approx(0.05, abs=5e-6)
