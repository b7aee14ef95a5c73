"""tidewater — a PySpark engine for landing, framing, batching and accounting
for machine data (logs, telemetry, flow records).

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built on Spark's DataFrame API, so Catalyst plans, prunes and
pushes down across operator boundaries.
"""

__version__ = "0.1.0"

# Python workers (Arrow folds, stateful streaming processors) must not need
# this package installed on the executors: functions and classes defined
# here are shipped by value with the task.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
