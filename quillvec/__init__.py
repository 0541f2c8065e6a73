"""quillvec: retrieval and vector analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks are shipped with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
