"""Complete runs: panel → ledger → scores, skill horizons, tests and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forecasters, inference, metrics, qa, reports
from tidemark.operators.origins import BacktestSpec
from tidemark.operators.panel import PanelSpec
from tidemark.plans import backtest
from tidemark.session import stage
from tidemark.sources import sinks


@dataclass
class Study:
    """Tables of one run. The ledger is staged once, because every other table reads it."""

    spec: BacktestSpec
    ledger: DataFrame
    arm_a: str = "lags_only"
    arm_b: str = "lags_meteo"
    dm_horizons: Sequence[int] = (1, 6, 12, 24)

    @cached_property
    def metrics(self) -> DataFrame:
        """Staged: skill horizons, deltas and gates all read it."""
        return stage(metrics.attach_skill(metrics.cell_metrics(self.ledger)), "metrics")

    @property
    def hstar(self) -> DataFrame:
        return metrics.hstar_summary(self.metrics, self.spec.horizon)

    @property
    def master(self) -> DataFrame:
        learned = self.ledger.filter(F.col("condition").isin(self.arm_a, self.arm_b) | (F.col("model") == "persistence"))
        return metrics.master_table(learned)

    def arms(self):
        return F.col("condition") == self.arm_a, F.col("condition") == self.arm_b

    def dm(self, rule: str = "overlap") -> DataFrame:
        a, b = self.arms()
        horizons = [h for h in self.dm_horizons if h <= self.spec.horizon]
        pairs = inference.paired_losses(self.ledger, a, b, horizons)
        return inference.diebold_mariano(
            pairs, rule, self.spec.stride, (self.arm_a, self.arm_b),
            cells=inference.cells_by_series(self.ledger, a, b, horizons),
        )

    def inference(self, rule: str = "overlap") -> DataFrame:
        label = {"overlap": "q_overlap", "bartlett": "q_auto", "legacy": "q_h_minus_1"}[rule]
        return inference.inference_table(self.dm(rule), label)

    @property
    def deltas(self) -> DataFrame:
        return reports.delta_table(self.metrics, *self.arms(), (self.arm_a, self.arm_b))

    @property
    def verdict(self) -> DataFrame:
        return reports.decision(reports.sign_counts(reports.fidelity_deltas(self.master, *self.arms())))

    def gates(self, series: Sequence[str], models: Sequence[str], conditions: Sequence[str]) -> DataFrame:
        return qa.ledger_gates(
            self.ledger, self.metrics, self.hstar, self.dm(), series, models, conditions, self.spec.horizon
        )

    def write(self, path: str) -> DataFrame:
        started = datetime.now(timezone.utc).isoformat()
        tables = {"ledger": self.ledger, "metrics": self.metrics, "hstar": self.hstar, "dm": self.dm()}
        return sinks.write_run(tables, path, started)


def run_hourly_study(panel: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec, seasonal: bool = True, **kw) -> Study:
    """Two-arm hourly study over all series at once: references, seasonal reference and direct learner."""
    recent = forecasters.recent_depth((1, spec.season, spec.season + 1)) if seasonal else 0
    rows = stage(backtest.prepare(panel, panel_spec, spec, recent, slim=True), "features")
    fitted = [backtest.ridge_arms(chunk_rows=panel_spec.block_rows)]
    if seasonal:
        fitted.append(backtest.seasonal_ar_arm(chunk_rows=panel_spec.block_rows))
    return Study(spec, stage(backtest.backtest(rows, spec, fitted), "ledger"), **kw)


def run_daily_batch(panel: DataFrame, panel_spec: PanelSpec, spec: BacktestSpec,
                    lags: Sequence[int] = (1, 2, 3, 7, 14, 21, 28)) -> Study:
    """Daily univariate batch (convention C): persistence, weekly persistence, seasonal reference, recursive learner."""
    recent = forecasters.recent_depth((*lags, spec.season + 1))
    rows = stage(backtest.prepare(panel, panel_spec, spec, recent, slim=True), "features")
    fitted = [
        backtest.seasonal_ar_arm(max_train_rows=None, chunk_rows=panel_spec.block_rows),
        backtest.recursive_arm(lags, chunk_rows=panel_spec.block_rows),
    ]
    return Study(spec, stage(backtest.backtest(rows, spec, fitted), "ledger"))
