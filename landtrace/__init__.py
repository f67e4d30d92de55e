"""Land-cover conversion analytics as lazy PySpark DataFrame operators."""

from landtrace.spec import CLASS_ROWS, ConversionSpec, class_table

__all__ = ["CLASS_ROWS", "ConversionSpec", "class_table"]
