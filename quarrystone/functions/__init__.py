"""Pure Column builders: cleaning, keys, units, hashing and statistics expressions."""
