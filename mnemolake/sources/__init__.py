"""sources layer of mnemolake."""
