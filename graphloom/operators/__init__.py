"""Operators on graphs, paths, seeds, distances and alignments."""
