"""Operators over tables of lines, tokens, measures, notes, chunks and results."""
