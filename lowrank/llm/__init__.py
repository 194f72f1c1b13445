"""Operators for large training-corpus pipelines.  Nothing else in the
library imports this subpackage."""
