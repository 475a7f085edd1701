"""rateflow: e-mail freight-rate tables as Spark DataFrame operators."""

__version__ = "0.1.0"
