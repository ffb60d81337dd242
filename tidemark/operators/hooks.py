"""User forecasters over the whole training prefix, by states that can be merged.

A prefix of any length never lies in one task. Rows are cut into chunks by position; every chunk is folded into a state of the
user's making, the states before each chunk are merged level by level, and a chunk is then gone through once more for the
origins whose prefix ends in it.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators.origins import BacktestSpec, origin_rows
from tidemark.session import stage

#: States merged one after another in one task.
FANOUT = 512


class PrefixHook(Protocol):
    """A forecaster whose knowledge of a prefix is a state. States are pickled between tasks.

    ``merge(a, b)`` takes the state of some rows and that of the rows right after them; it has to be associative, and ``init()``
    has to be neutral. ``update`` may change the state that it is given.
    """

    def init(self) -> Any: ...

    def update(self, state: Any, rows: pd.DataFrame) -> Any: ...

    def merge(self, first: Any, second: Any) -> Any: ...

    def predict(self, state: Any, origin: pd.Series) -> Sequence[float]: ...


def prefix_hook(
    features: DataFrame, spec: BacktestSpec, hook: PrefixHook, columns: Sequence[str] = (), chunk_rows: int = 4096, fanout: int = FANOUT
) -> DataFrame:
    """``series, origin_seq, preds[0][horizon]``: the hook's forecasts from all rows of each origin's training prefix.

    ``update`` gets rows in time order with ``ts, pos, y`` and ``columns``, ``predict`` the state of the prefix and the origin's
    row. It is called once per origin and returns one value per horizon (NaN: none). A chunk is read twice; a task holds one
    chunk, or ``fanout`` states.
    """
    names = ["ts", "pos", "y", *[c for c in columns if c not in ("ts", "pos", "y")]]
    rows = features.select("series", F.floor(F.col("pos") / chunk_rows).alias("c"), *names)

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = hook.update(hook.init(), pdf.sort_values("pos", ignore_index=True)[names])
        return pd.DataFrame({"series": [key[0]], "c": [key[1]], "state": [pickle.dumps(state)]})

    kind = features.schema["series"].dataType.simpleString()
    totals = stage(rows.groupBy("series", "c").applyInPandas(total, f"series {kind}, c long, state binary"), "prefix-states")
    before = _before(totals, hook, fanout, kind)
    at = origin_rows(features, spec)
    last = F.col("pos") + spec.train_end_offset
    # An origin without any training row belongs to the first chunk, before its first row.
    asks = at.select("series", F.greatest(F.floor(last / chunk_rows), F.lit(0)).alias("c"), "origin_seq", last.alias("last"), *names).join(
        before, ["series", "c"], "left"
    )

    def run(key: tuple, ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos", ignore_index=True)
        pos, out, done = own["pos"].to_numpy(), [], 0
        if len(ask):
            first = ask["state"].iloc[0]
            state = hook.init() if first is None else pickle.loads(first)
        for i in ask["last"].argsort(kind="stable"):
            row = ask.iloc[i]
            stop = int(np.searchsorted(pos, row["last"], side="right"))
            if stop > done:
                state, done = hook.update(state, own.iloc[done:stop][names]), stop
            preds = hook.predict(copy.deepcopy(state), row[names])
            out.append((key[0], int(row["origin_seq"]), [[float(v) for v in preds]]))
        return pd.DataFrame(out, columns=["series", "origin_seq", "preds"])

    fits = blocks.fresh(asks).groupBy("series", "c").cogroup(blocks.fresh(rows).groupBy("series", "c")).applyInPandas(
        run, f"series {kind}, origin_seq long, preds array<array<double>>"
    )
    return fits.withColumn("preds", F.transform("preds", lambda p: F.transform(p, lambda v: F.when(~F.isnan(v), v))))


def _before(totals: DataFrame, hook: PrefixHook, fanout: int, kind: str) -> DataFrame:
    """``series, c, state``: the merged states of all chunks before ``c`` (null for the first one).

    Groups of ``fanout`` chunks are merged inside, the groups' totals likewise one level up, and so on until a series is one group.
    """
    deepest = totals.agg(F.max("c")).first()[0] or 0  # one number
    schema = f"series {kind}, c long, state binary, g long, total binary"

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c", ignore_index=True)
        state, out = None, []
        for number, raw in zip(pdf["c"], pdf["state"], strict=True):
            out.append((key[0], number, state and pickle.dumps(state[0]), key[1], None))
            own = pickle.loads(raw)
            state = [own if state is None else hook.merge(state[0], own)]
        out.append((key[0], None, None, key[1], pickle.dumps(state[0])))
        return pd.DataFrame(out, columns=["series", "c", "state", "g", "total"]).astype({"c": "Int64"})

    merged = totals.withColumn("g", F.floor(F.col("c") / fanout)).groupBy("series", "g").applyInPandas(inside, schema)
    if deepest < fanout:
        return merged.filter("c IS NOT NULL").select("series", "c", "state")
    merged = stage(merged, "merged-states")
    above = _before(merged.filter("c IS NULL").select("series", F.col("g").alias("c"), F.col("total").alias("state")), hook, fanout, kind)
    joined = merged.filter("c IS NOT NULL").select("series", "c", "g", "state").join(
        above.select("series", F.col("c").alias("g"), F.col("state").alias("ahead")), ["series", "g"], "left"
    )

    def put_before(batches):
        for pdf in batches:
            states = []
            for ahead, state in zip(pdf["ahead"], pdf["state"], strict=True):
                both = ahead is not None and state is not None
                states.append(pickle.dumps(hook.merge(pickle.loads(ahead), pickle.loads(state))) if both else state if ahead is None else ahead)
            yield pdf[["series", "c"]].assign(state=states)

    return joined.select("series", "c", "state", "ahead").mapInPandas(put_before, f"series {kind}, c long, state binary")


# --- ready-made hooks


class RunningMean:
    """Mean of all known targets so far, for every horizon."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self):
        return 0, 0.0

    def update(self, state, rows):
        known = rows["y"].dropna()
        return self.merge(state, (len(known), known.mean() if len(known) else 0.0))

    def merge(self, first, second):
        n = first[0] + second[0]
        return (n, first[1] + (second[1] - first[1]) * second[0] / n) if n else first

    def predict(self, state, origin):
        return [state[1] if state[0] else np.nan] * self.horizon


class OnlineLeastSquares:
    """Least squares of the target on given columns, from counts, means and centred products, which merge without loss.

    ``known`` are columns of the training rows; ``ahead(origin, h)`` gives their values for horizon h.
    """

    def __init__(self, horizon: int, known: Sequence[str], ahead):
        self.horizon, self.known, self.ahead = horizon, list(known), ahead

    def init(self):
        width = len(self.known) + 1
        return 0, np.zeros(width), np.zeros((width, width))

    def update(self, state, rows):
        z = rows[[*self.known, "y"]].astype(float).dropna().to_numpy()
        if not len(z):
            return state
        mean = z.mean(axis=0)
        return self.merge(state, (len(z), mean, (z - mean).T @ (z - mean)))

    def merge(self, first, second):
        if not first[0] or not second[0]:
            return second if second[0] else first
        n, apart = first[0] + second[0], second[1] - first[1]
        return n, first[1] + apart * (second[0] / n), first[2] + second[2] + np.outer(apart, apart) * (first[0] * second[0] / n)

    def predict(self, state, origin):
        n, mean, products = state
        if n < len(mean) or not (np.diag(products)[:-1] > 0).all():
            return [np.nan] * self.horizon
        slopes = np.linalg.lstsq(products[:-1, :-1], products[:-1, -1], rcond=None)[0]
        return [mean[-1] + (np.asarray(self.ahead(origin, h), float) - mean[:-1]) @ slopes for h in range(1, self.horizon + 1)]
