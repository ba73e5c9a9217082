"""Training-data operators: dedup, mixing, filters, fingerprints, search, encoding.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
The task functions travel to the executors by value, so a cluster needs no copy of
this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
