"""Free-text survey coding on Spark: reconcile, train, score, triage and measure."""

__version__ = "0.1.0"
