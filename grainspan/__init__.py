"""Spark-first texture analytics: circular local binary patterns on dense grids."""

from .functions.dictionary import feature_dict, feature_lookup, reduced_feature_dict, reduction_map
from .functions.params import Run, npoints, radii, runs
from .operators.features import reduce_features, reduce_vectors
from .operators.lbp import lbp_codes
from .operators.masks import edit_mask, get_patch, patch_mask
from .plans.lbp_features import cached_features, features_to_npy, lbp_features
from .sources.pixels import create_sample_image, load_sample_image

__all__ = [
    "Run", "cached_features", "create_sample_image", "edit_mask", "feature_dict", "feature_lookup", "features_to_npy", "get_patch", "lbp_codes", "lbp_features", "load_sample_image", "patch_mask", "npoints", "radii", "reduce_features",
    "reduce_vectors", "reduced_feature_dict", "reduction_map", "runs",
]
__version__ = "0.2.0"
