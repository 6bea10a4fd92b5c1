"""Training-data operators: dedup, scans, selection, mixing, packing, output.

Nothing else in the library imports this subpackage."""
