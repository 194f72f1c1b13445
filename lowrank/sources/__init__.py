"""Readers and writers: tables, text matrices, run logs."""
