"""Column expressions."""

from tarnfield.functions.scalar import *  # noqa: F403
