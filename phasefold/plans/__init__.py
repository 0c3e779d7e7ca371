"""Execution of parameter grids: library broadcast after a check of its size, grid rows spread over tasks."""
