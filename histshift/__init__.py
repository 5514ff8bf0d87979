"""histshift: build-to-build regression detection on histogram telemetry, on Spark.

Every operator is a DataFrame transformation. The package is split into

* ``sources``   readers of ping tables, snapshots, CSV/JSON parts; fixture adapters; sinks
* ``functions`` column expressions (window bounds, Poisson weights, densities, names)
* ``operators`` profiles, bootstrap, RelDS, latest-wins, CDFs, summary statistics
* ``plans``     user-level entry points (comparison run, daily job, snapshots, views)
* ``streaming`` incremental fold of newly arrived runs into the published snapshots
"""

from histshift.config import RunConfig

__all__ = ["RunConfig"]
