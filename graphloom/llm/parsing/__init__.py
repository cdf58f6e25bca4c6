"""Recursive-descent parsers that tell whether a text is syntactically valid in its language."""
