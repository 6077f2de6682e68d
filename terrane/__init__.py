"""terrane: spatially constrained fuzzy regionalisation, and text-corpus operators, on Spark."""
