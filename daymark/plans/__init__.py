"""The feature language, its windows and definitions, and the queries."""
