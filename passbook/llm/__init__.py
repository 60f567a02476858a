"""Training-data operators: thirteen corpus jobs, each a module of this subpackage.

Nothing outside this subpackage imports it; ``queries.py`` lists what the
driver entry point registers.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors inside the job, so a
# cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
