"""All registered queries of the engine and their SQL counterparts."""

from lectern.plans import books, sentences, texts

QUERIES = texts.QUERIES | sentences.QUERIES | books.QUERIES
ORACLES = texts.ORACLES | sentences.ORACLES | books.ORACLES
