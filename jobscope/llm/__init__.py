"""Operations of a training-data pipeline over documents, pages and embeddings.

Functions that run on executors travel with their tasks, so workers need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
