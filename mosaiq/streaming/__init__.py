"""Incremental fits over Structured Streaming, and batch iteration over frames."""

from .incremental import DataLoader, Dataset, DetectMetricPlateau, RunningMoments, create_train_val_split, dataset_shuffle, fit_stream  # noqa: F401
