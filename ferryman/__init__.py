"""ferryman: Spark-native analytics for legacy-ETL migration estates.

Two halves:

* corpus jobs over tables of scripts and chunk-level conversion results
  (profiling, pricing, cleaning, segmentation, macro dependency order,
  quality verdicts, retry merging, usage roll-ups, job-step streams);
* the ETL operator catalogue (routers, lookups, joiners, aggregators,
  funnels, upserts, surrogate keys, transposes, value maps, incremental
  loads, data tests, fixed-width and packed-decimal decoding) executed as
  DataFrame operations.

Every query in :mod:`ferryman.plans.registry` takes ``(spark, sf_dir)`` and
returns a lazy DataFrame; nothing is collected to the driver.
"""

__version__ = "0.1.0"
