"""calltrail: analytics over logs of model, tool and agent calls, on PySpark.

Every operator takes and returns DataFrames (or Columns). Time ranges are
explicit arguments, nothing is collected to the driver inside an operator, and
no broadcast is forced: Catalyst broadcasts a side only when its measured size
is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its few Arrow functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
