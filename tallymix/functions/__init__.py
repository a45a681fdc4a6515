"""Column expressions and size checks shared by the operators."""
