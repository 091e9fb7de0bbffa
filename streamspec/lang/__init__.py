"""The specification language: syntax tree, parser, printer, units."""
