"""Column-level building blocks: vector algebra, integer bit tricks, statistics."""
