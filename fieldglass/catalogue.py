"""All registered queries of the library, without the training-data operators."""

from fieldglass.plans import detection, evaluation, gates, lines, pixels, readings, segments, sweeps, text, vectors  # noqa: F401  (each registers its queries)
from fieldglass.plans.registry import QUERIES, SQL  # noqa: F401
