"""The row-wise and bottom-k operators over streams of new score files."""
