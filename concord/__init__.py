"""Record fusion and ranked retrieval over Spark DataFrames."""

from concord.catalog import Catalog, FieldSpec

__all__ = ["Catalog", "FieldSpec"]
