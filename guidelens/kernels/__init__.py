"""Plain Python and numpy kernels: locating, scoring and aligning single sequences."""
