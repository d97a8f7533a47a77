"""Training-data operators: deduplication, search, sharding, mixing, tokenizing, extraction, toxicity.

Nothing else in the library imports this subpackage.  Its queries are listed in
``volscreen.llm.registry``.
"""

from pyspark import cloudpickle as _cloudpickle

import volscreen.llm as _self

# Executors need not have this package on their path: functions travel by value.
_cloudpickle.register_pickle_by_value(_self)
