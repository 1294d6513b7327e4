"""Read side: search, facets, browsing, identifiers, consortium views; write side: table operations by key."""
