"""Arrow UDFs that run once per row."""

from __future__ import annotations

from pyspark.sql.functions import arrow_udf


def once(return_type):
    """``arrow_udf`` marked nondeterministic, though the kernels are not.

    Spark copies deterministic expressions into filters it pushes down, so a
    condition on an embedding would run the model twice; these it leaves in place.
    """

    def wrap(fn):
        return arrow_udf(return_type)(fn).asNondeterministic()

    return wrap
