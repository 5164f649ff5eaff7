"""Runnable jobs over tables at given paths."""
