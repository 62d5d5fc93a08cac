"""One thread for dense algebra: OpenBLAS's own threads spin against each other when the cores are busy with Spark."""

from __future__ import annotations

import ctypes
import os
from contextlib import suppress

__all__ = ["single_threaded"]

#: Names under which builds of OpenBLAS export the setter.
SETTERS = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads")


def single_threaded() -> None:
    """For libraries not loaded yet through the environment, for a loaded one through its setter."""
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    with suppress(OSError):
        with open("/proc/self/maps") as maps:
            loaded = {line.split()[-1] for line in maps if "openblas" in line}
        for path in loaded:
            library = ctypes.CDLL(path)
            for name in SETTERS:
                if hasattr(library, name):
                    getattr(library, name)(1)
                    break
