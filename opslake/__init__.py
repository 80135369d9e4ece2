"""Operations analytics on Spark: job runs, alerts, queues, notifications, logs, query statistics and metrics."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so workers
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
