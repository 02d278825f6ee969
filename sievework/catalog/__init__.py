"""The catalogue of operations; importing it registers all of them."""

from . import accounts, cells, conversations, drift, jobs, profiles, retrieval, sources, streams  # noqa: F401
