"""Queries over the project's tables, each with an equivalent SQL text where SQL can say it."""
