"""All registered queries, by topic."""

from jobscope.entries import (  # noqa: F401
    corpora,
    history,
    live,
    migration,
    relations,
    scalars,
    search,
    statistics,
)
from jobscope.entries.registry import ORACLES, QUERIES  # noqa: F401
