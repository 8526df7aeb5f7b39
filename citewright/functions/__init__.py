"""Column functions: text normalisation, tokens, rules."""
