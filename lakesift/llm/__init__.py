"""Operators of a training-data pipeline, one module each, and their registered queries.

Nothing else in the library imports this subpackage; it may import the
library's general helpers."""
