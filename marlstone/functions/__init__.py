"""Column functions; Python ones travel with the job."""

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Let Python functions of a module travel with the job, so executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


#: Texts that a Python function has in hand at once, with what it makes of them; an Arrow batch has ten thousand rows.
SLICE = 256


def slices(batch):
    """An Arrow batch in parts, so what Python holds does not follow the size of the batch."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def arrow(schema: str):
    """A vectorised function of pandas Series as a function of columns; made when first used, when there is a session."""

    def wrap(f):
        made = []

        def call(*columns):
            from pyspark.sql import functions as F

            if not made:
                made.append(F.pandas_udf(f, schema))
            return made[0](*columns)

        call.__name__, call.__doc__, call.plain = f.__name__, f.__doc__, f
        return call

    return wrap


# What Python functions of any module look up in these travels too.
ship("marlstone.functions")
from .. import constants  # noqa: E402

ship(constants.__name__)
