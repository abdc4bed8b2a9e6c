"""Lexer, parser, syntax tree, and emission of Spark SQL."""
