"""Point-in-time screening, derivation and backtest jobs for daily bar panels, written as Spark DataFrame jobs."""
