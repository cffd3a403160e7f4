"""Readers that turn outside data into keyed DataFrames."""
