"""jobscope: analytics and migration pipelines for background-job queues, as plain PySpark jobs.

Every operator takes and returns DataFrames.  The sub-packages are

* ``functions``  scalar column expressions, also registered as SQL functions,
* ``sources``    readers and writers for job files, dumps, configurations and code,
* ``operators``  search, statistics, history, contracts, workflows, audits,
* ``plans``      migration plans: legacy formats to canonical jobs, validation, code analysis,
* ``streaming``  the live counterparts on Structured Streaming.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their tasks, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
