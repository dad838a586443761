"""mnemolake: citation-first retrieval and memory analytics as PySpark plans."""
