"""Column functions: names, classes of bytes and text, fields and references."""

from .scalar import *  # noqa: F403
