"""All registered queries of the library, with their SQL equivalents."""

from . import analysis, composed, encoding, events, eye, labels_triggers, loaders, masks, recordings, reports, star, stores, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
