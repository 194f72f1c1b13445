"""Principal-component analytics on Spark DataFrames."""

import sys as _sys


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the
    Arrow kernels without the package being installed on executors."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()

from .estimator import ProbabilisticPCA, ProbabilisticPCAModel  # noqa: E402
from .matrix import DENSE, SPARSE, TallMatrix  # noqa: E402
from .operators.ppca import PpcaModel, exact_pca, ppca_fit  # noqa: E402
from .session import ensure_checkpoint_dir, local_session, materialize  # noqa: E402

__all__ = ["DENSE", "SPARSE", "TallMatrix", "PpcaModel", "ProbabilisticPCA", "ProbabilisticPCAModel",
           "exact_pca", "ppca_fit",
           "ensure_checkpoint_dir", "local_session", "materialize"]
