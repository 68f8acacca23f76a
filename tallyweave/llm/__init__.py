"""Operations of a training-data pipeline: ten operators over documents, conversations and embeddings.

Nothing else in the library imports this subpackage. Functions that run on executors are pickled by
value, so a cluster needs only the public libraries they use, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
