"""Training-data pipeline operators: each module holds one operator with its own
interface; ``register`` holds the thin registered queries and their SQL."""
