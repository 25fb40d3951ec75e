"""Column-level functions: text, prompts, reply parsing, hashing."""
