"""Language and embedding models behind one injected client."""
