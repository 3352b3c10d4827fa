"""Sources: readers of captured payloads, transformers to one schema, configuration files."""
