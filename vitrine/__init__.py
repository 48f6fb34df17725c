"""vitrine: catalogue search and search analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from vitrine.session import build_session, shared_dir

# Functions that run inside tasks travel with the plan, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "shared_dir"]
