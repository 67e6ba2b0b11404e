"""Operators for building training corpora; nothing else in spanloom imports this package.

Functions that run in Python workers are pickled by value, so executors need the
third-party libraries but not this package on their path.
"""

import importlib

from pyspark import cloudpickle

for _name in ("vec", "common", "bpe", "mixing", "topk", "langid", "substring_dedup", "near_dedup", "html_extract"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
