"""Whole workflows composed of operators: ingest, train, backtest."""
