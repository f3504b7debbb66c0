"""Note-to-feature analytics expressed as lazy DataFrame and SQL plans."""
