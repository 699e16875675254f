"""Queries of the reference operators; importing this package registers them."""

from quire.plans import checks, evaluation, files, layouts, registry, rewards, typesetting  # noqa: F401
