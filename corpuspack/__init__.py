"""corpuspack: pack many repositories of files into size-limited Markdown
documents, and back, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from corpuspack.options import PackOptions

# Functions sent to tasks carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PackOptions"]
