"""Composite jobs: model fit/save/load, experiments, sweeps, baseline learners."""
