"""The three analyses, each a chain of operators."""
