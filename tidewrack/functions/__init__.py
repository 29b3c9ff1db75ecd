"""Part of tidewrack."""
