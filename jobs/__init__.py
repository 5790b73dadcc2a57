"""Runnable jobs: `python -m jobs.NAME --config FILE`, and `run(spark, config)` for callers with a session of their own."""
