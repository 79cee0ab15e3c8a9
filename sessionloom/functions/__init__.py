"""Column expressions and record helpers shared by operators."""
