"""Source relations: page lists, requests, cached responses."""
