"""Training-data operators: mixing, WARC archives, PII and secret scans, near-duplicates, line dedup,
main-text extraction, fingerprints, decontamination and quality scoring.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
