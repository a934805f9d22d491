"""Operators: DataFrame -> DataFrame building blocks, all lazy, all keyed by ``by``."""
