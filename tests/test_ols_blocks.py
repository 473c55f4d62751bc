import numpy as np
import pandas as pd
import pytest

from isochord.operators import stats


def r2(y, x):
    x = np.column_stack([np.ones(len(y)), *x]) if x else np.ones((len(y), 1))
    left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return 1 - left @ left / ((y - y.mean()) @ (y - y.mean()))


def test_blocks_and_controls_equal_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 0] - 2 * x[:, 1]          # a predictor that adds nothing
    y = x[:, 0] + 0.3 * x[:, 2] + rng.normal(size=300)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, g="k")
    df = spark.createDataFrame(pdf)
    df = df.unionByName(df.selectExpr("'k' AS g", "a", "b", "c", "d", "CAST(NULL AS DOUBLE) AS y"))
    df = df.unionByName(df.selectExpr("'flat' AS g", "a", "b", "c", "d", "1.0D AS y"))
    got = {r.g: r for r in stats.variance_partition(
        df, ["g"], "y", {"p": ["a", "b"], "q": ["c", "d"]}).collect()}
    a, b, c, d = x.T
    full, p, q = r2(y, [a, b, c, d]), r2(y, [a, b]), r2(y, [c, d])
    want = {"n": 300, "r2_full": full, "r2_p": p, "r2_q": q, "unique_p": full - q,
            "unique_q": full - p}
    for name, value in want.items():
        assert got["k"][name] == pytest.approx(value, abs=1e-9)
    assert got["flat"]["r2_full"] == 0.0
    out = stats.partial_corr(df.filter("g = 'k'"), ["g"], "y", "a", ["b", "c"]).first()

    def left(v):
        z = np.column_stack([np.ones(300), b, c])
        return v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    assert out.partial_corr == pytest.approx(np.corrcoef(left(y), left(a))[0, 1], abs=1e-9)
    gone = stats.partial_corr(df.filter("g = 'k'"), ["g"], "y", "d", ["a", "b"]).first()
    assert gone.partial_corr == pytest.approx(0.0, abs=1e-6)
