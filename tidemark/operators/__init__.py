"""All operators; importing this registers every one of them."""

from tidemark.operators import dedup, diversity, enrich, filters
from tidemark.operators.base import FilterOperator, Operator, TransformOperator

__all__ = ["FilterOperator", "Operator", "TransformOperator", "dedup", "diversity", "enrich", "filters"]
