"""One thread per task for numpy's products: Spark's tasks fill the cores already."""

from __future__ import annotations

import ctypes
import functools
import glob
import os

import numpy as np


@functools.cache
def single_thread() -> bool:
    """Set once per Python process; False where numpy's library is another one, which then stays as it is.

    More threads give the same results. They wait for each other by spinning, which for small
    matrices costs as much time of the processor as the products do.
    """
    folder = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs")
    for path in glob.glob(os.path.join(folder, "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return True
    return False
