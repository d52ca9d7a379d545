"""DataFrame -> DataFrame operators."""

from sidelines.operators.aggregates import *  # noqa: F401,F403
from sidelines.operators.windows import *  # noqa: F401,F403
from sidelines.operators.joins import *  # noqa: F401,F403
from sidelines.operators.reshape import *  # noqa: F401,F403
from sidelines.operators.ordering import *  # noqa: F401,F403
from sidelines.operators.filters import *  # noqa: F401,F403
