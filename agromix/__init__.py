"""Mixed-model analytics on Spark DataFrames."""

import numpy as _numpy  # noqa: F401  loaded first, so that its algebra library can be told

from agromix.functions.blas import single_threaded

single_threaded()
