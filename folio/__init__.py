"""folio: document-extraction and evaluation analytics as Spark jobs."""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python stages (pandas UDFs, mapInPandas backends) are pickled by value, so executors
    need no installed copy of this package."""
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: ship the package with --py-files instead
        pass


_ship_by_value()
