"""Named queries over the test tables, each with a DuckDB statement where SQL can say it."""

from docsift.queries import files, loaders, search, texts, vectors

QUERIES = {**vectors.QUERIES, **texts.QUERIES, **files.QUERIES, **loaders.QUERIES, **search.QUERIES}
ORACLES = {**vectors.ORACLES, **texts.ORACLES, **files.ORACLES, **loaders.ORACLES, **search.ORACLES}
