"""stepaudit: a PySpark engine that reviews completed agent runs at scale."""

__version__ = "0.1.0"
