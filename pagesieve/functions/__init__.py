"""Column functions: native Catalyst expressions, and Arrow functions around the page kernel."""

from .columns import *  # noqa: F403
from .pages import *  # noqa: F403
