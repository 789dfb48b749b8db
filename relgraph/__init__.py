"""Relationship graphs of people, built and queried with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with the tasks, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
