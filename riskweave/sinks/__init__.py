"""Writers: append, first-write-wins insert, keyed upsert, topics."""
