"""Static analyses: names, value types, clocks, dependencies."""
