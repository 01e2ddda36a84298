"""Column functions: text, names, organisations and domains."""
