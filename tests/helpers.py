import datetime as dt

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)


def random_panel(seed=0, series=("a", "b"), rows=400, missing=0.1, gaps=0.05, step_seconds=3600):
    """Hourly-like rows with missing values and skipped timestamps; deterministic."""
    rng = np.random.default_rng(seed)
    frames = []
    for i, name in enumerate(series):
        n = rows // (1 if i == 0 else 3)
        keep = rng.random(n) >= gaps
        ts = np.array([START + dt.timedelta(seconds=step_seconds * k) for k in range(n)])[keep]
        level = 20 + 5 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(0, 1, n).cumsum() * 0.1
        y = level[keep]
        x = rng.normal(0, 1, len(y)) + 0.3 * y
        y = np.where(rng.random(len(y)) < missing, np.nan, y)
        x = np.where(rng.random(len(y)) < missing, np.nan, x)
        frames.append(pd.DataFrame({"series": name, "ts": ts, "y": y, "x": x}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, "series string, ts timestamp, y double, x double").repartition(4)


def near(a, b, tol=1e-9):
    if a is None or b is None or (isinstance(a, float) and np.isnan(a)) or (isinstance(b, float) and np.isnan(b)):
        missing = lambda v: v is None or (isinstance(v, float) and np.isnan(v))
        return missing(a) and missing(b)
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
