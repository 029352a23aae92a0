"""graphloom: knowledge-graph construction, reasoning and grounded retrieval on PySpark.

Subpackages
-----------
functions   column functions (text, URIs, similarity) used by everything else
operators   relational, recursive and clustering operators over DataFrames
sources     readers and writers (Turtle, JSON documents, markdown trees, tagged tables)
plans       composed jobs (knowledge-base build, clean-up, question answering, evaluation)
streaming   the same plans over Structured Streaming
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
