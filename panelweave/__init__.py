"""panelweave: panel preparation, economic metrics and panel econometrics on Spark DataFrames."""

__version__ = "0.1.0"
