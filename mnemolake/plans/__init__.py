"""The query registry: importing this package registers all queries."""

from mnemolake.plans import library, registry, surfaces  # noqa: F401
