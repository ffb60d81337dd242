"""Forecast-horizon evaluation on Spark: panels, rolling origins, ledgers, scores and tests."""
