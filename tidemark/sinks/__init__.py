"""Renderers and writers of rows, diffs and patches."""
