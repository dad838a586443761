"""functions layer of mnemolake."""
