"""Estimators, graphs, inference and treatment-effect operators."""
