"""Types and scalar expressions."""

from quillstone.functions.expr import binary, col, describe, lit, null_literal, simplify, unary
from quillstone.functions.types import Type

__all__ = ["Type", "binary", "col", "describe", "lit", "null_literal", "simplify", "unary"]
