"""Column functions: itemsets as sorted arrays, hashes, text parsing."""
