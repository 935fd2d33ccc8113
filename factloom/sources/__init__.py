"""Reading and writing: articles, catalogs, observations, pages; upserts, exports, hand-offs."""
