"""DataFrame operators: nearest neighbours, pairs, snippets, pages, statistics."""
