"""quarry: retrieval, graph and evaluation operators for code and text corpora, as Spark plans."""
