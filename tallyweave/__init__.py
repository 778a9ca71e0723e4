"""tallyweave: reconciliation and large-scale data preparation as Spark plans."""

__version__ = "0.1.0"
