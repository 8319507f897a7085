"""Readers that make document DataFrames, and the mutation log."""
