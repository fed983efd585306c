"""veil: result semantics of external-memory private-data algorithms as Spark DataFrame operators."""

__version__ = "0.1.0"
