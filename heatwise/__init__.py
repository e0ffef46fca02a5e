"""heatwise: thermal-reading leak analytics as Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function (or returns a small
driver-side summary built from a bounded aggregate). Sub-packages:

* ``sources``   -- file discovery, delimited reading ingest, labelled CSV, scoring
                   batches, images, the driver-table bridge views, synthetic readings.
* ``functions`` -- column expressions (categories, flags, tiers, right-closed bins).
* ``operators`` -- labels, features, ordered (global rank/rolling/quantile), EDA,
                   selection, sampling, evaluation.
* ``plans``     -- compositions: labelling pipeline, model training, scoring, sinks.
* ``streaming`` -- Structured Streaming scoring and labelling.
"""

from heatwise.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
