"""canopy: warehouse-operator analytics written as plain Spark DataFrame jobs.

Sub-packages:
  functions/  Column -> Column helpers (arrays, JSON maps, hierarchy paths, strings, generators)
  operators/  DataFrame -> DataFrame operators (hierarchies, lookup, profiles, logs, skew, workload)
  sources/    readers and writers (server/GC/process logs, listings, remote loads, dumps)
  plans/      the registered queries over the driver tables and their DuckDB oracles
  streaming/  Structured Streaming forms of the polling jobs
"""

from canopy.session import get_spark, checkpoint_dir, scratch_path  # noqa: F401

__version__ = "0.1.0"
