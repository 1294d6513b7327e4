"""Training-data operators over a corpus of documents.

Nothing else in the library imports this subpackage.  Its functions are shipped to executors by
value, so workers need numpy and pyarrow but not this package on their path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
