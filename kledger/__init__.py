"""kledger: analytics over large stores of short, sourced notes, as PySpark DataFrame operators."""

__version__ = "0.1.0"
