import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def walk(spark):
    """Bars of several symbols with different lengths; one flat, one with two bars."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for name, n in (("A", 320), ("B", 260), ("C", 79), ("D", 80), ("E", 59), ("F", 60), ("G", 2), ("FLAT", 230)):
        close = 100 + np.cumsum(rng.normal(0, 2, n)) if name != "FLAT" else np.full(n, 50.0)
        open_ = close + (rng.normal(0, 1, n) if name != "FLAT" else 0)
        spread = rng.uniform(0.1, 3, n) if name != "FLAT" else np.zeros(n)
        frames.append(pd.DataFrame({
            "symbol": name, "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "open": open_,
            "high": np.maximum(open_, close) + spread, "low": np.minimum(open_, close) - spread,
            "close": close, "volume": rng.integers(1, 1000, n).astype(float)}))
    pdf = pd.concat(frames).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf).repartition(5), pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
