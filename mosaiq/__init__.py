"""mosaiq: distributed array analytics as DataFrame plans."""

from .array import Array, array, asarray, broadcast_shapes, broadcast_to, from_frame, sanitize_axis, sanitize_shape  # noqa: F401
from .functions.types import can_cast, canonical, e, finfo, iinfo, inf, issubdtype, nan, newaxis, pi, promote_types, result_type  # noqa: F401
from .operators.elementwise import *  # noqa: F403
from .operators.factories import *  # noqa: F403
from .operators.reductions import *  # noqa: F403
from .operators.manipulations import *  # noqa: F403
from .operators import factories as random  # noqa: F401
from .operators import linalg, signal, sparse  # noqa: F401
from .operators import signal as fft  # noqa: F401
from .operators.distance import Laplacian, cdist, manhattan, rbf  # noqa: F401
from .operators.linalg import cross, det, dot, inv, matmul, matrix_norm, norm, outer, projection, tensordot, trace, transpose, tril, triu, vdot, vecdot, vector_norm  # noqa: F401
from .operators.signal import convolve, convolve2d  # noqa: F401
from .sources.io import load, load_csv, load_csv_from_folder, load_npy_from_path, load_parquet, save, save_csv  # noqa: F401
