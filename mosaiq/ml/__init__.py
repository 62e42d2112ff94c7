"""Estimators over frames of row vectors: row_id, x (array of double)."""

from .base import is_classifier, is_clusterer, is_estimator, is_regressor, is_transformer  # noqa: F401
from .cluster import BatchParallelKMeans, BatchParallelKMedians, KMeans, KMedians, KMedoids, Spectral, silhouette_samples, silhouette_score  # noqa: F401
from .decomposition import DMD, PCA, DMDc, IncrementalPCA  # noqa: F401
from .supervised import GaussianNB, KNeighborsClassifier, Lasso  # noqa: F401
from .scalers import MaxAbsScaler, MinMaxScaler, Normalizer, RobustScaler, StandardScaler  # noqa: F401
