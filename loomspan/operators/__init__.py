"""DataFrame operators: search, store, windows, transforms, entropy, codec, mining."""
