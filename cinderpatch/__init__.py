"""Spark-native jobs over raster patches: read, derive features, train, score, report.

A *patch* is a row: scalars and one array column per band, row-major, ``size * size`` values long. A
*pixel* is a row: the patch's id, the position in the patch and one plain column per band.
"""

from .operators.metrics import confusion, metrics, threshold_report
from .plans.dataset import load_patches, split_bands
from .plans.train import MODELS, build_model, fit_with_validation
from .sources.schema import patch_struct, read_schema
from .sources.tfrecord import read_tfrecords

__all__ = [
    "MODELS",
    "build_model",
    "confusion",
    "fit_with_validation",
    "load_patches",
    "metrics",
    "patch_struct",
    "read_schema",
    "read_tfrecords",
    "split_bands",
    "threshold_report",
]
