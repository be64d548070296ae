"""groundeval: Spark-native evaluation of how far generated text is grounded in a corpus.

Every operator is a plain function ``fn(df, ..., **params) -> DataFrame``; nothing is
collected in library code, so Catalyst and adaptive execution plan the whole job.

Sub-packages
    functions   Column-expression builders (tokenisers, parsers, LCS, bins, prompts).
    sources     Readers and writers for the reference's file formats.
    operators   DataFrame-in / DataFrame-out operators (overlap, metrics, grid, reports ...).
    plans       Stand-in inputs derived from the driver tables and the query catalogue.
    streaming   Micro-batch scoring of arriving predictions with the same operators.
"""

import sys as _sys

from groundeval.session import checkpoint_dir, get_spark

# Python code that runs inside tasks (Arrow-batched scans, injected predictors) is pickled
# by value, so executors need no installed copy of this package.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

__all__ = ["get_spark", "checkpoint_dir"]
