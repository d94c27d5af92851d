"""vireo: Spark-native operators for retrieval, ranking evaluation, recommendation
and batched model scoring.

Every operator takes and returns lazy DataFrames; see README.md for the map of
modules to operators.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the
    Arrow-batch operators without the package installed on the executors."""
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: workers import the package
        pass


_ship_by_value()
