"""Spark jobs for price-bar series (ingest, clean, match, forecast, score, backtest) and training-data text."""
