"""Operators on DataFrames: anchors, votes, intervals, runs, sequences, graphs, scores."""
