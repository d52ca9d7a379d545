"""Column-level helpers.  All return ``pyspark.sql.Column`` and stay JVM-side."""

from sidelines.functions.nulls import *  # noqa: F401,F403
from sidelines.functions.text import *  # noqa: F401,F403
from sidelines.functions.domain import *  # noqa: F401,F403
from sidelines.functions.factor import *  # noqa: F401,F403
