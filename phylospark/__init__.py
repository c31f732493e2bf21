"""Phylogenetic diversity analytics as DataFrame and SQL plans."""

from phylospark.api import *  # noqa: F403
from phylospark.api import __all__  # noqa: F401
