"""Case-crossover analytics on Spark DataFrames."""

from .operators import *  # noqa: F401,F403
from .plans import *  # noqa: F401,F403
from .sources import *  # noqa: F401,F403
