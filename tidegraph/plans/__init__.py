"""Iterative programs: model fitting and prediction."""
