"""The subpackage's queries and the SQL that checks them."""

from importlib import import_module

#: Modules with QUERIES, and ORACLES where SQL can express one.
MODULES = ("byte_bpe", "token_files", "warc", "quality", "toxicity", "fingerprints", "substrings", "near_duplicates", "token_counts", "decontaminate", "prefix_tries", "lexical_search", "secret_scans")


def _gathered(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), name, {}).items()}


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLES")
