"""Operators of a training-data pipeline. Nothing outside this package imports it."""

MODULES = [
    "weftline.llm.leaks",
    "weftline.llm.names",
    "weftline.llm.neighbours",
    "weftline.llm.pairs",
    "weftline.llm.pii",
    "weftline.llm.survivorship",
    "weftline.llm.tokens",
]
