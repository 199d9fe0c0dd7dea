"""Whole jobs: load, materialize, train, promote, score."""
