"""tessera: corpus preparation and run-log analytics as plain Spark jobs.

Subpackages
-----------
sources    readers (JSONL, JSON, CSV, Parquet, text, prompts, metrics, traces), recipes
functions  column expressions (pre-tokenisers, normalisation, previews, hashing)
operators  DataFrame -> DataFrame building blocks (order, slices, splits, vocab,
           encode, pack, samples, run logs, event logs)
plans      end-to-end jobs composed from operators (corpus build, pretokenize, reports)
streaming  Structured Streaming variants of the incremental jobs
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    # Python functions of this package used in pandas UDFs are pickled by
    # value, so executors need no installed copy of the package.
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older pyspark
        pass


_ship_by_value()
