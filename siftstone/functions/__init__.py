from . import columns, distributions, fixed

__all__ = ["columns", "distributions", "fixed"]
