"""caseflow — event-log (process-mining) analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function built on the
public Spark SQL / DataFrame API, so Catalyst plans it and the cluster scales
it.  Layers:

* ``sources``    — log adapters, experiment (runs / history) tables, sinks
* ``operators``  — preparation, splits, features, encoding, sequences,
                   baseline model, prefix / transition statistics,
                   evaluation, experiment analytics
* ``functions``  — column-expression helpers and ordered-window utilities
* ``plans``      — end-to-end compositions (baseline run, prefix report) and
                   the registered queries with their SQL oracles
* ``streaming``  — incremental directly-follows counting over a stream
"""

def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (pandas
    UDFs, applyInPandas, mapInPandas) need no installed copy of it."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()

from caseflow.spec import LogSpec, EventAttributes, EOS, PAD, UNK  # noqa: F401,E402
from caseflow.session import get_spark, configure  # noqa: F401,E402

__all__ = ["LogSpec", "EventAttributes", "EOS", "PAD", "UNK", "get_spark", "configure"]
