"""Error types of the library."""


class LevelError(ValueError):
    """A criterion was used at a level it doesn't have."""


class CriterionError(ValueError):
    """A criterion's parameters contradict each other or don't fit the pool."""


class ChartError(ValueError):
    """A chart's data breaks one of its guards."""


class IncompleteMatrixError(ValueError):
    """A distance matrix lacks distances that an operation needs."""
