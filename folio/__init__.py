"""folio: libraries of structured documents and question banks, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions and state processors travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
