"""streaming layer of mnemolake."""
