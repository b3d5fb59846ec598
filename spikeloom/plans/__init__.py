"""Fits: distributed Newton steps and per-unit optimizers, cross-validation, sampling, model comparison."""
