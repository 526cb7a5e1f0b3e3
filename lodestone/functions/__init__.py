"""Scalar functions as Column expressions: all of them stay in Catalyst."""

from .binary import *  # noqa: F403
from .scalars import *  # noqa: F403
