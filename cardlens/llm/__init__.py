"""Operators for building language-model training data.

Thirteen operators over ``documents``, ``pages`` and ``embeddings``, one module each, and their
registered queries (``queries.py``).  Nothing else in the library imports this
subpackage.  Functions that run on executors are shipped by value, so the
executors need numpy, pyarrow and the tokenizer libraries but not this source.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
