"""Column helpers (JVM-side expressions, no Python UDFs)."""

from claimspark.functions.text import *  # noqa: F401,F403
from claimspark.functions.vectors import *  # noqa: F401,F403
from claimspark.functions.misc import *  # noqa: F401,F403
