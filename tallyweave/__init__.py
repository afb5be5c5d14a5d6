"""Bank-statement data to balanced accounting vouchers, as Spark DataFrame operators."""

__version__ = "0.1.0"
