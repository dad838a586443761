"""operators layer of mnemolake."""
