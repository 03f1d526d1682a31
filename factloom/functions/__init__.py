"""Column functions: normalisation, typing, inflection, literals."""
