"""Scoring of streamed query cases with a fitted model."""
