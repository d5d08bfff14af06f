"""Mapping functions as Column builders, found by the last part of their IRI."""

from .registry import FunctionError, Functions, udf  # noqa: F401
from . import arrays, controls, dates, maths, others, strings  # noqa: F401, E402
