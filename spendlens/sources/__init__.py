"""Feed readers, the curated table sink and the sample feeds."""
