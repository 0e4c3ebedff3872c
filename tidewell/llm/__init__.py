"""Operators for training-data pipelines. Nothing else in tidewell imports this subpackage."""
