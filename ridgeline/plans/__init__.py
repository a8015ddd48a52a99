"""Shared plans: checkpoints, sample restriction, absorption of fixed effects."""
