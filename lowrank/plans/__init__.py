"""Registered DataFrame plans over the given tables and their SQL twins."""
