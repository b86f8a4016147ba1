"""Column functions: cleaning, names, model text, screening, sets, observations."""
