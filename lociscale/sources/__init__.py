"""Readers of tables, tracks, annotations, sequences and containers, and writers that can be checked."""
