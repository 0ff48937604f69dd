"""tarifa: price analytics on search and listing tables, as Spark DataFrame operators."""

from .session import get_spark

__all__ = ["get_spark"]
