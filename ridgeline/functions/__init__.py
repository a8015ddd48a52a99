"""Formulas and special functions."""
