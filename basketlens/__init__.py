"""basketlens: e-commerce product metrics as Spark DataFrame plans."""

from basketlens.params import Params, fixture_params, default_params  # noqa: F401
from basketlens.sources.tables import Tables  # noqa: F401

__version__ = "0.1.0"
